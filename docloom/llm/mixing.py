"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's budget in words is its weighted share of all words, at most
`max_epochs` times what it has; what is above goes to the others by weight.
A budget is met by complete epochs (every document of the source, 0 to 3
times) and then a fraction of one: documents ordered by exponential keys
-ln(u)/w, u being a hash of doc_id and w the document's quality weight, and
taken while the prefix sum of their words lies in what is left.  The document
on the edge is cut there, so that a source meets its budget to the word.

Prefix sums are kept in two levels: keys fall into `BUCKETS` ranges a source,
whose sums are pre-aggregated, and only within a range are rows ordered.  A
source that holds most rows so spreads over as many tasks as there are ranges.

Defined results: null text counts 0 words; a null source is a source of its
own, the last one; a null doc_id gets the hash of the empty string; repeated
rows are documents of their own; documents without words are taken 0 words of;
an empty table gives an empty result.  Columns beside those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
QUALITY = {1: 2.0, 0: 0.5}
UNLABELLED = 1.0
MAX_EPOCHS = 3
BUCKETS = 4096
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of an MD5."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Water-filling: target = min(cap, level * weight).  With sources ordered by
    cap / weight, the level is the largest of what is left over the weights
    that are left, over all prefixes.  One row a source; no document is here.
    """
    ranked = sizes.withColumn("n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    order = W.orderBy(F.col("cap") / F.col("weight"), "n")
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    return ranked.withColumn("target", F.least("cap", F.max("level").over(every) * F.col("weight"))).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, labels: DataFrame | None = None, weights=WEIGHTS, quality=QUALITY, max_epochs: int = MAX_EPOCHS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken for every row of `docs`.

    `labels` (doc_id, quality), if given, sets the documents' quality weights;
    of repeated labels the best counts.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    weight = F.lit(UNLABELLED)
    if labels is not None:
        best = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        sized = sized.join(best, "doc_id", "left")
        for value, w in quality.items():
            weight = F.when(F.col("quality") == value, F.lit(float(w))).otherwise(weight)
    key = -F.log(uniform(F.col("doc_id"), seed)) / weight
    keyed = cut(sized.select("doc_id", "source", "size", key.alias("key")), "mix-sizes")
    keyed = keyed.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(F.lit(buckets) * (1 - F.exp(-F.col("key"))))).cast("int"))

    sums = cut(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(starts["source"].alias("s"), F.col("bucket").alias("b"), "start", "source_size", "target", "epochs", "rest")

    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.join(starts, keyed["source"].eqNullSafe(starts["s"]) & (keyed["bucket"] == starts["b"]))
    placed = placed.withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("at")))
    return placed.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


ORACLE = rf"""
WITH sized AS (
  SELECT d.doc_id, d.source,
         coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE l.quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w,
         (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':{SEED}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
keyed AS (SELECT *, -ln(u) / w AS key FROM sized),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM keyed GROUP BY source),
wt AS (SELECT *, (CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM src),
lv AS (SELECT *, ((SELECT sum(source_size) FROM src)::DOUBLE
         - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
tg AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM lv) * weight) AS target FROM lv),
tr AS (SELECT *, (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT AS epochs FROM tg),
placed AS (SELECT k.doc_id, k.source, k.size, t.source_size, t.target, t.epochs,
         round(t.target - t.epochs * t.source_size)::BIGINT AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
       FROM keyed k JOIN tr t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (epochs * size + greatest(0, least(size, rest - begins)))::BIGINT AS taken
FROM placed
"""
