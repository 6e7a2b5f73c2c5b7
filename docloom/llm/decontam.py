"""Benchmark decontamination by latent semantic retrieval.

The benchmark is the query set; it is taken in blocks of bounded size.  Its
items are cut into passages of `WINDOW` words, weighted by TF-IDF whose
document frequencies are counted over all documents.  A distributed randomised
SVD gives a latent space for each `SPACE` passages, so that a passage keeps
nearly all of its length in its space however large the benchmark is: products
with the passage table run on the executors, for many spaces at once, only the
thin factors come to the driver.  Every window of every document (`WINDOW`
words, half overlapping) is folded into each space and compared by cosine with
its passages; a window whose share of weight in words of the space is below
the threshold cannot reach it and is passed over, which loses nothing.  Words
that the benchmark does not have weigh as much as its median word.

Candidates are then checked in the words themselves: the longest common
subsequence of a passage and the window with its surroundings, each word
counted by its idf, must cover `COVER` of the passage, or `COVER_ANSWER` where
the item's answer (its answer column, else its last sentence) is there too.
So paraphrases with changed, moved or dropped words are found, and chance
meetings of common words are not.  Passages of less than `SHORT` words must be
there word for word.

Defined results: null and empty texts and items match nothing; an item that is
repeated counts once for each item_id, and items without an id are items (their
item_id is null); a document that matches several items
gives a row each; repeated documents each give their rows; empty tables give
an empty result (no benchmark: nothing is contaminated); other columns are
ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import cut, small_batches, spread

WINDOW = 32
RANK = 192
#: Passages of a latent space: few enough that RANK keeps nearly all of their length.
SPACE = 256
COSINE = 0.4
COVER = 0.58
COVER_ANSWER = 0.5
SHORT = 8
#: Items and characters of a block, taken at once: bounds the vocabulary, the factors and the broadcast.
BLOCK_ITEMS = 2000
BLOCK_CHARS = 1 << 21
#: Terms whose factors are computed at once.
SVD_TERMS = 16384
POWER_ROUNDS = 2
OVERSAMPLE = 16
_CLEAN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256)).lower()
_SENTENCE = re.compile(r"[.?!;\n]+")
_SLICE = 4096


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_CLEAN).split()


def passages_of(n: int, size: int = WINDOW) -> list[tuple[int, int]]:
    """Half overlapping ranges that cover n words; the last one ends with them."""
    if n <= size:
        return [(0, n)] if n else []
    return [(s, s + size) for s in range(0, n - size, size // 2)] + [(n - size, n)]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one range after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


@dataclass
class Items:
    """A block of the benchmark."""

    index: dict[bytes, int]  # word -> number
    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    passages: list[tuple[int, int, int]]  # item, from, to


def read_items(rows: list[tuple[int, str | None, str | None]]) -> Items:
    index: dict[bytes, int] = {}
    number = lambda ws: np.array([index.setdefault(w, len(index)) for w in ws], dtype=np.int64)
    out = Items(index, [], [], [], [])
    for item, text, answer in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or "")):
        w = number(words((text or "").encode("utf-8", "replace")))
        if not len(w):
            continue
        if answer is None:
            sentences = [s for s in (words(x.encode("utf-8", "replace")) for x in _SENTENCE.split(text)) if s]
            answer_words = sentences[-1] if len(sentences) > 1 else []
        else:
            answer_words = words(answer.encode("utf-8", "replace"))
        out.passages += [(len(out.ids), s, e) for s, e in passages_of(len(w))]
        out.ids.append(item)
        out.words.append(w)
        out.answers.append(number(answer_words))
    return out


def document_frequencies(docs: DataFrame, index: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Over all documents: how many hold each of the benchmark's words; how many there are."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, n = shared.value, 0
        df = np.zeros(len(index) + 1, dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                df[[index[w] for w in index.keys() & set(words(text.as_py()))]] += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["term", "n"])

    df = np.zeros(len(index) + 1)
    for r in docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    return df[:-1], int(df[-1])


def randomised_svd(table: DataFrame, n_terms: int, rank: int, rounds: int = POWER_ROUNDS, seed: int = 17) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of a table of sparse rows (ids, weights)."""
    return randomised_svds(table, [(n_terms, rank)], rounds, seed)[0]


def randomised_svds(table: DataFrame, spaces: list[tuple[int, int]], rounds: int = POWER_ROUNDS, seed: int = 17) -> list[np.ndarray]:
    """`randomised_svd` of each (n_terms, rank), whose rows and terms follow each other in one table.

    Each round is one pass: A'AQ is summed by term over the partitions.
    """
    widths = [min(rank + OVERSAMPLE, n) for n, rank in spaces]
    edges = np.concatenate([[0], np.cumsum([n for n, _ in spaces])])
    n_terms, width = int(edges[-1]), max(widths)
    own = [(slice(edges[k], edges[k + 1]), slice(0, w)) for k, w in enumerate(widths)]
    q = np.zeros((n_terms, width))
    for at, (n, _), w in zip(own, spaces, widths, strict=True):
        q[at] = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, w)))[0]
    columns = [f"c{i}" for i in range(width)]
    for _ in range(rounds):
        shared = table.sparkSession.sparkContext.broadcast(q)

        def product(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q = shared.value
            out, touched = np.zeros(q.shape), np.zeros(len(q), dtype=bool)
            for batch in batches:
                for ids, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out[ids] += np.outer(w, np.asarray(w) @ q[ids])
                    touched[ids] = True
            at = np.flatnonzero(touched)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(out[at, k]) for k in range(q.shape[1]))], ["term", *columns])

        got = table.select("ids", "weights").mapInArrow(product, "term int, " + ", ".join(f"{c} double" for c in columns))
        got = got.groupBy("term").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
        b = np.zeros((n_terms, width))
        if got.num_rows:
            b[got.column("term").to_numpy()] = np.stack([got.column(c).to_numpy() for c in columns], axis=1)
        small = [q[at].T @ b[at] for at in own]  # Q'A'AQ
        last, q = q, np.zeros_like(q)
        for at in own:
            q[at] = np.linalg.qr(b[at])[0]
    out = []
    for at, m, (_, rank) in zip(own, small, spaces, strict=True):
        value, vector = np.linalg.eigh((m + m.T) / 2)
        out.append(last[at] @ vector[:, np.argsort(-value)[:rank]])
    return out


def covered(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> float:
    """The share of a's weight in the heaviest common subsequence of a and b."""
    best = np.zeros(len(b) + 1)
    for t in a.tolist():
        hit = best.copy()
        hit[1:] = np.maximum(best[1:], best[:-1] + np.where(b == t, weight[t], 0.0))
        best = np.maximum.accumulate(hit)
    return float(best[-1] / max(weight[a].sum(), 1e-12))


def holds(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether a is in b word for word."""
    return any(np.array_equal(b[i : i + len(a)], a) for i in np.flatnonzero(b[: len(b) - len(a) + 1] == a[0])) if len(a) <= len(b) else False


@dataclass
class Space:
    """The latent space of the passages from `start` on."""

    start: int
    rows: np.ndarray  # word -> row of folded; the last entry stands for all words that the benchmark does not have
    folded: np.ndarray  # terms x rank, times idf; the last row is zero
    latent: np.ndarray  # passages x rank, of unit length
    least: np.ndarray  # cosine that each passage asks for


@dataclass
class Matcher:
    items: Items
    idf: np.ndarray  # the last entry stands for all words that the benchmark does not have
    spaces: list[Space]

    def match(self, texts: list[bytes | None]) -> list[list[tuple[int, float, float, bool, int]]]:
        """For each text the items it holds: (item_id, cosine, share, answer found, word)."""
        half = WINDOW // 2
        docs = [self._numbers(words(t)) for t in texts]
        found: list[list] = [[] for _ in docs]
        sizes = np.array([len(w) for w in docs], dtype=np.int64)
        if not sizes.sum():
            return found
        known = np.concatenate(docs)  # words of the benchmark by number, others below -1, each its own
        tokens = np.maximum(known, -1).astype(np.int32)
        base = np.concatenate([[0], np.cumsum(sizes)])
        # Half windows of all texts; a window is two that follow each other in a text, or a text's only one.
        halves = -(-sizes // half)
        doc_of = np.repeat(np.arange(len(docs)), halves)
        lo = np.arange(len(doc_of)) * half - np.repeat(np.cumsum(halves * half) - halves * half, halves) + base[doc_of]
        follows = np.append(doc_of[1:] == doc_of[:-1], False)
        alone = halves[doc_of] == 1
        first = np.flatnonzero(follows | alone)
        second = np.where(alone[first], len(doc_of), first + 1)
        ends = np.append(lo[1:], len(tokens))
        starts, stops = lo[first], np.where(alone[first], ends[first], ends[np.minimum(second, len(ends) - 1)])
        weight = self._counted(known, tokens, starts, stops)
        norm = np.maximum(np.add.reduceat(weight, np.cumsum(stops - starts) - (stops - starts)), 1e-12)
        here = tokens[_ranges(starts, stops - starts)]
        for space in self.spaces:
            inside = np.add.reduceat(np.where(space.rows[here] < len(space.folded) - 1, weight, 0.0), np.cumsum(stops - starts) - (stops - starts))
            go = inside >= (space.least.min() * (1 - 1e-6)) ** 2 * norm
            self._near(space, space.rows[tokens], lo, ends, first[go], second[go], np.sqrt(norm[go]).astype(np.float32), doc_of, base, sizes, found)
        return [self._check(np.maximum(docs[d], -1), c) if c else [] for d, c in enumerate(found)]

    def _numbers(self, ws: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.items.index.get, ws, itertools.repeat(-1)), dtype=np.int64, count=len(ws))
        at = np.flatnonzero(out < 0)
        out[at] = -2 - (np.fromiter((hash(ws[i]) for i in at.tolist()), dtype=np.int64, count=len(at)) & 0x3FFFFFFFFFFFFFFF)
        return out

    def _counted(self, known: np.ndarray, tokens: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """For each word of each window, one window after another, its idf^2 times how often the window has it."""
        out = np.zeros(int((stops - starts).sum()))
        done = 0
        for i in range(0, len(starts), 4 * _SLICE):
            s, size = starts[i : i + 4 * _SLICE], (stops - starts)[i : i + 4 * _SLICE]
            at = _ranges(s, size)
            row, col = np.repeat(np.arange(len(s)), size), at - np.repeat(s, size)
            grid = np.full((len(s), WINDOW), np.iinfo(np.int64).max) - np.arange(WINDOW)  # what is missing equals nothing
            grid[row, col] = known[at]
            order = np.argsort(grid, axis=1, kind="stable")
            ordered = np.take_along_axis(grid, order, axis=1)
            count = np.ones(grid.shape)
            for lag in range(1, WINDOW):
                same = ordered[:, lag:] == ordered[:, :-lag]
                if not same.any():
                    break
                count[:, lag:] += same
                count[:, :-lag] += same
            back = np.empty_like(count)
            np.put_along_axis(back, order, count, axis=1)
            out[done : done + len(at)] = back[row, col] * self.idf[tokens[at]] ** 2
            done += len(at)
        return out

    @staticmethod
    def _near(space: Space, rows, lo, ends, first, second, norm, doc_of, base, sizes, found: list[list]) -> None:
        """Adds to `found` the passages of a space that are near to the windows (first, second) of half windows."""
        half = WINDOW // 2
        for i in range(0, len(first), _SLICE):
            f, g = first[i : i + _SLICE], second[i : i + _SLICE]
            need = np.unique(np.concatenate([f, g[g < len(doc_of)]]))
            length = ends[need] - lo[need]
            at = np.repeat(lo[need] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            grid = np.full((len(need), half), len(space.folded) - 1, dtype=np.int64)  # the last row is zero
            grid[np.repeat(np.arange(len(need)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = rows[at]
            x = np.zeros((len(need) + 1, space.folded.shape[1]), dtype=np.float32)
            for k in range(half):
                x[:-1] += space.folded.take(grid[:, k], axis=0)
            sums = x[np.searchsorted(need, f)] + x[np.where(g < len(doc_of), np.searchsorted(need, g), len(need))]
            sums /= norm[i : i + _SLICE, None]
            sims = sums @ space.latent.T
            for r, p in zip(*np.nonzero(sims >= space.least), strict=True):
                d = doc_of[f[r]]
                start = int(lo[f[r]] - base[d])
                found[d].append((float(sims[r, p]), space.start + int(p), start, min(start + WINDOW, int(sizes[d]))))

    def _may_cover(self, p: int, region: set[int]) -> bool:
        """Words in any order bound what words in order can cover."""
        item, s, e = self.items.passages[p]
        total = here = 0.0
        for t in self.items.words[item][s:e].tolist():
            w = self.weights[t]
            total += w
            if t in region:
                here += w
        return here >= COVER_ANSWER * total

    @cached_property
    def weights(self) -> list[float]:
        return self.idf.tolist()

    def _check(self, doc: np.ndarray, candidates: list[tuple[float, int, int, int]]) -> list[tuple[int, float, float, bool, int]]:
        out: dict[int, tuple] = {}
        for cosine, p, lo, hi in sorted(candidates, reverse=True):
            item, s, e = self.items.passages[p]
            if item in out:
                continue
            passage = self.items.words[item][s:e]
            region = doc[max(0, lo - WINDOW // 2) : hi + WINDOW // 2]
            if e - s < SHORT:
                share, answer = float(holds(passage, region)), False
            elif not self._may_cover(p, set(region.tolist())):
                continue
            else:
                share, a = covered(passage, region, self.idf), self.items.answers[item]
                wide = doc[max(0, lo - len(self.items.words[item])) : hi + len(self.items.words[item])]
                answer = share >= COVER_ANSWER and len(a) >= 3 and covered(a, wide, self.idf) >= 0.8
            if share >= COVER or answer:
                out[item] = (self.items.ids[item], cosine, share, answer, lo)
        return list(out.values())


def matchers(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cosine: float = COSINE) -> Iterator[Matcher]:
    """A matcher for each block of the benchmark."""
    spark = docs.sparkSession
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"), answer.alias("answer"))
    items = items.distinct()
    n_items, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).head()
    blocks = max(-(-n_items // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        block = read_items([tuple(r) for r in some.collect()])
        if not block.passages:
            continue
        df, n = document_frequencies(docs, block.index)
        idf = np.log((n + 1) / (df + 1)) + 0.05
        idf = np.append(idf, max(0.05, float(np.median(idf))))

        yield Matcher(block, idf, latent_spaces(spark, block, idf, rank, cosine))


def latent_spaces(spark: SparkSession, block: Items, idf: np.ndarray, rank: int, cosine: float) -> list[Space]:
    """Spaces of at most `SPACE` passages that follow each other, over all passages of a block."""
    n = -(-len(block.passages) // SPACE)
    edges = np.linspace(0, len(block.passages), n + 1).astype(int)
    terms = [np.unique(np.concatenate([block.words[item][s:e] for item, s, e in block.passages[a:b]])) for a, b in itertools.pairwise(edges)]
    # Spaces whose factors are computed together, and where the terms of each begin among theirs.
    group, offset, size = [], [], 0
    for t in terms:
        new = not group or size + len(t) > SVD_TERMS
        group.append((group[-1] + new) if group else 0)
        offset.append(0 if new else size)
        size = offset[-1] + len(t)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, ids, weights = [], [], []
            for p in batch.column(0).to_pylist():
                item, s, e = block.passages[p]
                t, c = np.unique(block.words[item][s:e], return_counts=True)
                w = c * idf[t]
                k = int(np.searchsorted(edges, p, side="right")) - 1
                groups.append(group[k])
                ids.append((offset[k] + np.searchsorted(terms[k], t)).tolist())
                weights.append((w / np.sqrt(w @ w)).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))], ["space", "ids", "weights"])

    table = cut(spark.range(len(block.passages)).mapInArrow(vectors, "space int, ids array<int>, weights array<double>"), "decontam-passages")
    out = []
    for g in range(group[-1] + 1):
        mine = [k for k in range(n) if group[k] == g]
        factors = randomised_svds(table.where(F.col("space") == g), [(len(terms[k]), min(rank, len(terms[k]), int(edges[k + 1] - edges[k]))) for k in mine])
        for k, v in zip(mine, factors, strict=True):
            rows = np.full(len(idf), len(v), dtype=np.int32)
            rows[terms[k]] = np.arange(len(v))
            folded = np.vstack([v * idf[terms[k], None], np.zeros((1, v.shape[1]))]).astype(np.float32)
            latent, least = [], []
            for item, s, e in block.passages[edges[k] : edges[k + 1]]:
                w = block.words[item][s:e]
                times = np.unique(w, return_counts=True)[1]
                x = folded[rows[w]].sum(axis=0)
                latent.append(x / max(float(np.linalg.norm(x)), 1e-12))
                # What a copy keeps in the latent space, and what a short passage weighs in a window.
                kept = float(np.linalg.norm(x)) / float(np.sqrt(((times * idf[np.unique(w)]) ** 2).sum()))
                least.append(cosine * min(1.0, kept) * np.sqrt(min(1.0, (e - s) / WINDOW)))
            out.append(Space(int(edges[k]), rows, folded, np.array(latent, dtype=np.float32), np.array(least, dtype=np.float32)))
    return out


_SCHEMA = "doc_id long, item_id long, cosine double, share double, answer boolean, at_word int"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, share, answer, at_word of every document that holds a benchmark item."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    out = None
    for matcher in matchers(docs, benchmark):
        shared = spark.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                flat = [(ids[d], *m) for d, ms in enumerate(shared.value.match(batch.column(1).to_pylist())) for m in ms]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], k) for i, k in enumerate(kinds)], ["doc_id", "item_id", "cosine", "share", "answer", "at_word"])

        found = spread(rows).mapInArrow(run, _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], _SCHEMA)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with all their columns."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    small_batches(spark, 256)
    for matcher in matchers(docs, benchmark):
        shared = spark.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t.encode("utf-8", "surrogatepass") if t is not None else None for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array([not m for m in shared.value.match(texts)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
