"""Sinks: Markdown files by path, results and reports as JSON, asset tables, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.convert import report


def write_markdown(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One row a document, as Parquet: doc_id, format, markdown."""
    results.where("error_code is null").select("doc_id", "format", "markdown").write.mode(mode).partitionBy("format").parquet(path)


def write_assets(results: DataFrame, path: str, mode: str = "errorifexists", assets: str = "extract") -> None:
    """Assets once for each content; `assets` may be extract, embed (as data URIs) or omit."""
    if assets == "omit":
        return
    x = results.select(F.explode("assets").alias("a")).select("a.*").dropDuplicates(["sha256"])
    if assets == "embed":
        x = x.withColumn("content", F.concat(F.lit("data:"), F.col("media_type"), F.lit(";base64,"), F.base64("content")))
    x.write.mode(mode).parquet(path)


def write_bundle(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Markdown, assets, results without content as JSON, and the report, below one folder."""
    write_markdown(results, f"{path}/markdown", mode)
    write_assets(results, f"{path}/assets", mode)
    slim = results.withColumn("assets", F.transform("assets", lambda a: a.dropFields("content"))).drop("markdown")
    slim.write.mode(mode).json(f"{path}/results")
    report(results.withColumn("outcome", F.coalesce("error_code", F.lit("complete")))).write.mode(mode).json(f"{path}/report")
