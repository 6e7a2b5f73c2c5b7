"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut

#: Edges that one task joins at once (16 MB); more go in rounds over all tasks.
AT_ONCE = 1 << 20


def _lowest(edges: DataFrame) -> DataFrame:
    """a, least of a and its b."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a and b in `label`, which names the least member of each node's group."""
    while True:
        p, q = label[a], label[b]
        apart = p != q
        if not apart.any():
            return
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label[:] = label[label]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = np.arange(len(nodes))
        hook(label, at[: len(a)], at[len(a) :])
        far = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], ["a", "b"])


def stars(edges: DataFrame, tag: str = "components", at_once: int = AT_ONCE) -> DataFrame:
    """Edges (a, b) of longs -> (a, b): every node but its component's least, and that least.

    At most `at_once` edges are joined by one task.  More take rounds, each of
    two aggregations to a minimum and two joins on a node; no neighbourhood is
    ever gathered, so a hub may hold any share of the edges.  Rounds go as the
    logarithm of the longest path.  Nodes without an edge to another node give
    no row.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    if now.count() <= at_once:
        return cut(now.coalesce(1).mapInArrow(_joined, "a long, b long"), tag, now)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.where("b > a").join(_lowest(both), F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(now.join(_lowest(both), F.col("a") == F.col("k")).select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        low = _lowest(large)
        small = large.join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        now = cut(small, tag)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.count_distinct("a")).first()
        if seen[0] == seen[2] and tuple(seen) == mark:
            return now
        mark = tuple(seen)
