"""The conversion pipeline over a stream of files: stateless, resumable, each input converted once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.plans.convert import classify, convert


def start(docs: DataFrame, out: str, checkpoint: str, options_key: str = "default", **options) -> StreamingQuery:
    """Converts what arrives and appends it to Parquet at `out`, by (input_sha256, options).

    A batch that runs again after a failure overwrites its own folder, so its
    rows are there once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        done = classify(convert(batch, **options)).withColumn("options_key", F.lit(options_key))
        done.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest(results: DataFrame) -> DataFrame:
    """One row for each input and options, the latest epoch's."""
    rest = [c for c in results.columns if c not in ("input_sha256", "options_key", "epoch")]
    best = results.groupBy("input_sha256", "options_key").agg(F.max_by(F.struct(*rest), "epoch").alias("r"), F.max("epoch").alias("epoch"))
    return best.select("input_sha256", "options_key", "epoch", "r.*")


def event_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums of events by window and type; batch and stream alike."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
