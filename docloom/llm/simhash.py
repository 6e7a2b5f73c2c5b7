"""SimHash near-duplicates, linked exactly through vantage-point trees.

Every document gets a 64-bit fingerprint of its whole text.  The bits are
dealt to radius + 1 masks: fingerprints that differ in `radius` bits at most
agree on one of the masks.  For each mask the distinct fingerprints are dealt
into shards by a vantage-point tree over the Hamming distance on its bits,
fitted on a bounded sample: a node holds a vantage point v and a radius mu, and
a fingerprint x lives inside if d(v, x) <= mu, else outside.  Those that agree
on the mask are at one distance from every v, so they always live together: a
fingerprint has one copy a mask at any size of the table, nobody visits, and
every linked pair meets in a shard.  Shards that hold too much are dealt by
trees of their own; where all of a shard agree on its mask, the bits that vary
in it are dealt to masks anew.  Within a shard the same goes on until blocks
are small enough to be compared directly.

A shard reports a spanning star of each group it finds, never the pairs, and
the stars of all shards are joined by `graph.stars`.

Defined results: null and wordless texts have fingerprint zero and are linked
like any other; rows are never merged, so repeated rows keep a row each; a null
doc_id counts as no candidate for component_id (null if a component has no
other); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docloom.llm.graph import hook, stars
from docloom.session import cut, small_batches, spread

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Distinct fingerprints that a shard should hold; sampled fingerprints that the trees are fitted on.
SHARD = 8192
SAMPLE = 16384
#: A shard of more than OVERFULL * SHARD gets a tree of its own, on some SHARD_SAMPLE of its points.
OVERFULL = 4
SHARD_SAMPLE = 2048
#: Levels of a tree; points that are compared directly; rows that are dealt, or shingles that are hashed, at once.
DEPTH = 64
DIRECT = 1024
BLOCK = 1 << 16
ALL = (1 << 64) - 1
DEALT = "shard int, bits long, fp long"


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of UTF-8 text."""
    words = (text or b"").lower().split()
    n = max(1, len(words) - size + 1) if words else 0
    if not n:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else iter([b" ".join(words)])
    ones = np.zeros(64, dtype=np.int64)
    hashes = map(xxhash.xxh64_intdigest, grams, itertools.repeat(SEED))
    while len(h := np.fromiter(itertools.islice(hashes, BLOCK), dtype="<u8")):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))).mapInArrow(run, "doc_id long, fp long")


def shares(bits: int, radius: int = RADIUS) -> list[int]:
    """The bits of a mask, dealt to radius + 1 masks: fingerprints that differ in `radius` of the bits at most agree on one mask."""
    at = [b for b in range(64) if bits >> b & 1]
    return [sum(1 << b for b in at[i :: radius + 1]) for i in range(radius + 1)]


def _varying(x: np.ndarray) -> int:
    """The bits in which some of the fingerprints differ."""
    return int(np.bitwise_or.reduce(x) ^ np.bitwise_and.reduce(x)) if len(x) else 0


def _split(points: np.ndarray, mask: int, rng: np.random.Generator, sample: int = 2048, tries: int = 12) -> tuple[np.uint64, int]:
    """The vantage point and radius, of a few candidates, that halve the points best; where none divides the sample, a point and zero."""
    some = points if len(points) <= sample else points[rng.integers(0, len(points), sample)]
    v = some[rng.integers(0, len(some), tries)]
    d = np.bitwise_count((some[None, :] ^ v[:, None]) & np.uint64(mask)) + 65 * np.arange(tries)[:, None]
    home = np.bincount(d.ravel(), minlength=65 * tries).reshape(tries, 65).cumsum(axis=1) / len(some)
    at, mu = divmod(int(np.abs(home - 0.5).argmin()), 65)
    return (v[at], mu) if home[at, mu] < 1 else (v[0], 0)


def grow(points: np.ndarray, mask: int, leaf: int, seed: int = 7) -> list[tuple]:
    """A tree as a list of nodes: (vantage point, mu, inside, outside), or (None, shard)."""
    rng, nodes, shard = np.random.default_rng(seed), [], itertools.count()

    def add(x: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        if len(x) <= leaf or depth == DEPTH or not _varying(x) & mask:
            nodes[at] = (None, next(shard))
            return at
        v, mu = _split(x, mask, rng)
        inside = np.bitwise_count((x ^ v) & np.uint64(mask)) <= mu
        nodes[at] = (int(v), mu, add(x[inside], depth + 1), add(x[~inside], depth + 1))
        return at

    add(points, 0)
    return nodes


def route(nodes: list[tuple], x: np.ndarray, mask: int) -> np.ndarray:
    """The shard in which each fingerprint lives."""
    shard, todo = np.zeros(len(x), dtype=np.int32), [(0, np.arange(len(x)))]
    while todo:
        at, who = todo.pop()
        if nodes[at][0] is None:
            shard[who] = nodes[at][1]
        elif len(who):
            v, mu, inside, outside = nodes[at]
            home = np.bitwise_count((x[who] ^ np.uint64(v)) & np.uint64(mask)) <= mu
            todo += [(inside, who[home]), (outside, who[~home])]
    return shard


def local_stars(x: np.ndarray, mask: int, radius: int) -> np.ndarray:
    """For each point of a shard the index of the least point of its group (all links between points that agree on the mask)."""
    label, rng, held = np.arange(len(x)), np.random.default_rng(11), [[], [], 0]

    def join() -> None:
        if not held[2]:
            return
        a, b = np.concatenate(held[0]), np.concatenate(held[1])
        held[0], held[1], held[2] = [], [], 0
        hook(label, a, b)

    def hold(a: np.ndarray, b: np.ndarray) -> None:
        held[0].append(a)
        held[1].append(b)
        held[2] += len(a)
        if held[2] > 1 << 20:
            join()

    todo = [(np.arange(len(x)), mask)]
    while todo:
        who, bits = todo.pop()
        y = x[who]
        if len(who) <= DIRECT:
            r, c = np.nonzero(np.bitwise_count(y[:, None] ^ y[None, :]) <= radius)
            hold(who[r[r < c]], who[c[r < c]])
        elif (varying := _varying(y)) & bits:
            v, mu = _split(y, bits, rng, 512, 4)
            home = np.bitwise_count((y ^ v) & np.uint64(bits)) <= mu
            todo += [(who[home], bits), (who[~home], bits)]
        elif varying.bit_count() <= radius:
            hold(who, np.full(len(who), who[0]))
        else:  # they agree on the mask: what varies is dealt to masks again
            todo += [(who, share) for share in shares(varying, radius)]
    join()
    return label


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[list[np.ndarray]]:
    """The columns of some `rows` rows at a time, as a tree's nodes cost the same for many rows as for few."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(batch.num_columns)]
            held, n = [], 0
    if n:
        yield [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(held[0].num_columns)]


def _dealt(shard: np.ndarray, bits: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(bits.view(np.int64)), pa.array(x.view(np.int64))], ["shard", "bits", "fp"])


def _planted(masks: list[int], points: np.ndarray, leaf: int, free: int) -> tuple[list[tuple], int]:
    """(mask, tree, its first shard's number) for each mask, and the next free number."""
    trees = []
    for mask in masks:
        nodes = grow(points, mask, leaf)
        trees.append((mask, nodes, free))
        free += sum(node[0] is None for node in nodes)
    return trees, free


def link(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Distinct fp -> (a, b): each fp that is linked to others, and the least one of its component."""
    n = fps.count()
    every = max(8, -(-n // sample))
    some = np.array([r[0] for r in fps.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).collect()], dtype=np.int64).view(np.uint64)
    trees, free = _planted(shares(ALL, radius), some, max(16, shard // every), 0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (fp,) in _gathered(batches):
            x = fp.view(np.uint64)
            for mask, nodes, first in trees:
                yield _dealt(route(nodes, x, mask) + np.int32(first), np.full(len(x), mask, dtype=np.uint64), x)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["fp"].to_numpy().view(np.uint64)
        label = local_stars(x, int(pdf["bits"].to_numpy()[:1].view(np.uint64)[0]), radius)
        linked = label != np.arange(len(x))
        fp = x.view(np.int64)
        return pd.DataFrame({"a": fp[linked], "b": fp[label[linked]]})

    dealt = cut(spread(fps.select("fp")).mapInArrow(deal, DEALT), "simhash-dealt")
    while (finer := split_again(dealt, radius, shard, free)) is not None:
        dealt, free = cut(finer[0], "simhash-dealt", dealt), finer[1]
    return stars(dealt.groupBy("shard").applyInPandas(pairs, "a long, b long"), "simhash-links")


def split_again(dealt: DataFrame, radius: int, shard: int, free: int) -> tuple[DataFrame, int] | None:
    """Shards that hold too much, dealt by trees of their own, and the next free number; None if there is none.

    A shard whose points agree on its mask goes on by what varies among them.
    """
    sizes = dealt.groupBy("shard", "bits").agg(F.count("*").alias("n"), F.bit_or("fp").alias("some"), F.bit_and("fp").alias("all"))
    big = {r["shard"]: r for r in sizes.where(F.col("n") > OVERFULL * shard).collect()}
    big = {k: r for k, r in big.items() if ((r["some"] ^ r["all"]) & ALL).bit_count() > radius}
    if not big:
        return None
    every = F.create_map(*(F.lit(x) for k, r in big.items() for x in (k, -(-r["n"] // SHARD_SAMPLE))))[F.col("shard")]
    some = dealt.where(F.col("shard").isin(list(big)) & (F.pmod(F.xxhash64("fp", "shard"), every) == 0)).select("shard", "fp").toArrow()
    of, points = some.column("shard").to_numpy(), some.column("fp").to_numpy().view(np.uint64)
    trees = {}
    for k, r in big.items():
        varying, mine = (r["some"] ^ r["all"]) & ALL, points[of == k]
        masks = [r["bits"] & ALL] if varying & r["bits"] else shares(varying, radius)
        if len(mine):
            trees[k], free = _planted(masks, mine, max(16, shard * len(mine) // r["n"]), free)
            for i, (mask, nodes, first) in enumerate(trees[k]):
                if len(nodes) == 1:  # the sample agrees on the mask, not all of the shard does
                    trees[k][i] = (mask, [(int(mine[0]), 0, 1, 2), (None, 0), (None, free - first)], first)
                    free += 1
    if not trees:
        return None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, bits, fp in _gathered(batches):
            x = fp.view(np.uint64)
            rest = ~np.isin(at, list(trees))
            yield _dealt(at[rest], bits[rest], x[rest])
            for k in np.unique(at[~rest]).tolist():
                mine = x[at == k]
                for mask, nodes, first in trees[k]:
                    yield _dealt(route(nodes, mine, mask) + np.int32(first), np.full(len(mine), mask, dtype=np.uint64), mine)

    return dealt.mapInArrow(deal, DEALT), free


def roots_of(least: DataFrame, radius: int) -> DataFrame:
    """(fp, least, root) of a table of distinct fp and what its rows are led by."""
    links = link(least, radius)
    return least.join(links, least["fp"] == links["a"], "left").select("fp", "least", F.coalesce("b", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of `docs`."""
    found = cut(fingerprints(docs), "simhash")
    least = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = roots_of(least, radius)
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.select("fp", "root").join(names, "root").select(F.col("fp").alias("f"), "component_id")
    return found.join(named, found["fp"] == named["f"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id, with all its columns.

    Rows are told apart as rows: those that repeat a doc_id with other texts
    are other documents, of copies with one doc_id one stays, and rows without
    a doc_id stay where their group has no other.  The documents are written
    once with their fingerprints and numbers, and read again without the rows
    that go; only numbers and fingerprints are shuffled, but for the join that
    drops rows, whose kind Spark chooses by how many go.
    """
    fp, row = (f"{c}_{len(docs.columns)}" for c in ("simhash_fp", "simhash_row"))
    at, bare = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py().encode("utf-8", "surrogatepass") if t.is_valid else None) for t in batch.column(at)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], [*batch.schema.names, fp])

    small_batches(docs.sparkSession)
    tagged = docs.mapInArrow(run, StructType([*bare.fields, StructField(fp, LongType())]))
    tagged = cut(tagged.withColumn(row, F.monotonically_increasing_id()), "simhash-tagged")
    rows = tagged.select(F.col(fp).alias("fp"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row")).alias("lead"))
    least = cut(rows.groupBy("fp").agg(F.min("lead").alias("least")), "simhash-distinct")
    roots = roots_of(least, radius)
    stays = roots.groupBy("root").agg(F.min("least").alias("stays"))
    named = roots.select("fp", "root").join(stays, "root").select(F.col("fp").alias("f"), F.col("stays.row").alias("stays"))
    gone = cut(rows.join(named, F.col("fp") == F.col("f")).where(F.col("lead.row") != F.col("stays")).select(F.col("lead.row").alias(row)), "simhash-gone")
    return tagged.join(gone, row, "left_anti").select(*docs.columns)
