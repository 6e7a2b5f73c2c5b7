"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words; every word of the examples is one.  A term weighs
(1 + ln tf) * idf * telling: idf is counted over all documents, and `telling`
(from `FLOOR` to 1) says how far the term tells the labelled classes apart, by
chi-square and odds.  No term is left out: words that tell little, and words
that no example has, weigh at least `FLOOR` of their idf and lengthen the
vector of a text.  The labelled examples are a bounded sample: at most
`EXAMPLES` of each class, by a hash of doc_id, each weighted by how many of its
class it stands for.

The examples form an inverted index.  The lists of rare terms are added up
whole; those of frequent terms (`FREQUENT` examples or more) are cut into
blocks of `BLOCK` examples with their largest weight, and give each example a
bound.  Examples are taken in descending order of bound, with their exact
cosines, until no further one can reach the k-th best: the nearest examples
are exact, ties go to the smaller example number.  Their votes, weighted by
squared cosine, are turned into a probability by isotonic regression on the
examples' own leave-one-out votes.  The nearest examples are returned as
evidence.

Defined results: null and empty texts, and texts that share no word with an
example, score what such examples score; repeated labels of a document
count once, as toxic if any is; labels that are null or of unknown documents
are ignored; without labels of both classes every score is the toxic share (0
if there is none); a null doc_id counts as not held out; repeated rows are scored each on its own; an empty table
gives an empty result; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut, release, small_batches, spread

EXAMPLES = 4096
BLOCK = 8
FREQUENT = 2048
NEAREST = 16
#: The cut of `predicted`; the least `telling`; the chi-square at which it is a half; the prior's weight in a vote.
CUT = 0.3
FLOOR = 0.02
CHI2 = 40.0
PRIOR = 0.5
#: Texts whose scores a task keeps at hand, for their copies.
SEEN = 1 << 15
#: Words that a task counts before it looks them up.
HELD = 1 << 18
_CLEAN = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256)).lower()


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_CLEAN).split()


def train_fold(doc_id) -> object:
    """Rows that labels may be learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2, F.lit(True))


def sample_labels(labels: DataFrame, per_class: int = EXAMPLES) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic) of a bounded sample of each class, and the classes' sizes."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(train_fold(F.col("doc_id")))
    known = cut(known, "toxicity-labels")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    some = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return cut(some[0].unionByName(some[1]), "toxicity-sample"), sizes


def telling(a: np.ndarray, b: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """How far terms tell the classes apart, that a of n0 and b of n1 examples hold: from `FLOOR` to 1."""
    n, share = n0 + n1, n1 / (n0 + n1)
    expected = (a + b) * share
    off = np.maximum(0.0, np.abs(b - expected) - 0.5)
    chi2 = off * off / np.maximum(expected * (1 - share) * np.maximum(1 - (a + b) / n, 1e-3), 1e-9)
    odds = np.abs(np.log((b + 0.5) / (n1 + 1)) - np.log((a + 0.5) / (n0 + 1)))
    return np.maximum(FLOOR, chi2 / (chi2 + CHI2) * -np.expm1(-odds))


def document_frequencies(docs: DataFrame, index: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Over all documents: how many hold each word of `index`; how many there are."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, n = shared.value, 0
        df = np.zeros(len(index) + 1, dtype=np.int64)
        held: Counter[bytes] = Counter()  # of texts since the last time; a word is looked up once for them

        def settle() -> None:
            at = np.fromiter(map(index.get, held, itertools.repeat(len(index))), dtype=np.int64, count=len(held))
            np.add.at(df, at, np.fromiter(held.values(), dtype=np.int64, count=len(held)))
            held.clear()

        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                held.update(set(words(text.as_py())))
                if len(held) > HELD:
                    settle()
        settle()
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["term", "n"])

    got = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(index) + 1)
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return df[:-1], int(df[-1])


def _lists(start: np.ndarray, items: np.ndarray) -> pa.LargeBinaryArray:
    """`items` of 8 bytes as the lists that begin at `start`, without a copy; Arrow gathers whole lists."""
    ends = np.append(start, len(items)).astype(np.int64) * 8
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(items)])


def _edge(bound: np.ndarray, step: int) -> float:
    """The step-th largest bound; below all of them if there are no more."""
    return np.partition(bound, len(bound) - step)[len(bound) - step] if len(bound) > step else 0.0


@dataclass
class Index:
    """Inverted lists of examples given as (terms, weights) of each."""

    n: int
    start: np.ndarray  # of each term's list
    size: np.ndarray
    posting: np.ndarray  # the lists: an example's number and the bits of its float32 weight, side by side
    row: np.ndarray  # of a frequent term among the block maxima; -1: rare
    most: np.ndarray  # block maxima of the frequent terms
    own: np.ndarray  # each example's weights of the frequent terms

    @classmethod
    def of(cls, sparse: list[tuple[np.ndarray, np.ndarray]], n_terms: int, frequent: int = FREQUENT) -> Index:
        sizes = np.array([len(t) for t, _ in sparse], dtype=np.int64)
        term = np.concatenate([np.zeros(0, np.int32), *(t for t, _ in sparse)], dtype=np.int32, casting="same_kind")
        weight = np.concatenate([np.zeros(0), *(w for _, w in sparse)])
        example = np.repeat(np.arange(len(sparse), dtype=np.int32), sizes)
        size = np.bincount(term, minlength=n_terms)
        row = np.where(size >= frequent, np.cumsum(size >= frequent) - 1, -1)
        often = np.flatnonzero((size >= frequent)[term])
        at, of = row[term[often]], example[often]
        most = np.zeros((int((row >= 0).sum()), -(-max(1, len(sparse)) // BLOCK)))
        weight = weight.astype(np.float32)
        np.maximum.at(most, (at, of // BLOCK), weight[often])
        own = np.zeros((len(sparse), len(most)), dtype=np.float32)
        own[of, at] = weight[often]
        order = np.argsort(term, kind="stable")
        del term  # the driver has little memory for what the arrays are made of
        posting = np.empty((len(order), 2), dtype=np.int32)
        posting[:, 0] = example[order]
        posting[:, 1] = weight[order].view(np.int32)
        return cls(len(sparse), np.cumsum(size) - size, size, posting.view(np.int64)[:, 0], row, most, own)

    @cached_property
    def lists(self) -> pa.LargeBinaryArray:
        return _lists(self.start, self.posting)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lists"}

    def nearest(self, ids: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Example numbers and cosines of the k nearest that share a term."""
        row = self.row.take(ids)
        often = row[row >= 0]
        rare = ids[row < 0]
        size = self.size.take(rare)
        n = int(size.sum())
        part = np.zeros(self.n)
        if n:
            got = np.frombuffer(self.lists.take(pa.array(rare)).buffers()[2], dtype=np.int32, count=2 * n).reshape(-1, 2)
            add = np.repeat(w[row < 0], size)
            add *= got[:, 1].view(np.float32)
            part = np.bincount(got[:, 0].astype(np.intp), add, self.n)
        bound = part + np.repeat(w[row >= 0] @ self.most[often], BLOCK)[: self.n]
        if skip >= 0:
            bound[skip] = 0.0
        query = np.zeros(len(self.most))
        query[often] = w[row >= 0]
        near, sims, step = np.zeros(0, dtype=np.int64), np.zeros(0), 4 * k
        floor = np.nextafter(0.0, 1.0)
        edge = _edge(bound, step)
        # Those of the largest bounds first; all that share the last of them go along.
        e = np.flatnonzero(bound >= max(edge, floor))
        while len(e):
            # Every row is added up in the same way, so that copies tie.
            s = part[e] + (self.own[e] * query).sum(axis=1)
            near, sims = np.concatenate([near, e[s > 0]]), np.concatenate([sims, s[s > 0]])
            best = np.lexsort((near, -sims))[:k]
            near, sims, step = near[best], sims[best], step * 2
            if len(near) == k:
                floor = max(floor, sims[-1] - 1e-12)
            left = np.flatnonzero((bound < edge) & (bound >= floor))
            edge = _edge(bound[left], step)
            e = left[bound[left] >= edge]
        return near, sims


@dataclass
class Model:
    terms: dict[bytes, int]
    weights: np.ndarray  # idf * telling of each term
    unknown: float  # the same of words that no example has: as if in one document
    ids: np.ndarray  # of the examples
    toxic: np.ndarray
    stands_for: np.ndarray
    k: int = NEAREST
    prior: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] | None = None  # the isotonic map
    empty_score: float = 0.0
    index: Index | None = None
    seen: dict[bytes, tuple] = field(default_factory=dict)  # scores of the latest texts

    def vector(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of a whole text's terms; of unit length together with the words that are no terms."""
        counts = Counter(words(text))
        ids = np.fromiter(map(self.terms.get, counts, itertools.repeat(-1)), dtype=np.int64, count=len(counts))
        tf = 1 + np.log(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
        w = tf * np.where(ids >= 0, self.weights[ids], self.unknown) if len(self.weights) else tf
        known = ids >= 0
        return ids[known], w[known] / max(np.sqrt(w @ w), 1e-300)

    def nearest(self, ids: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.index.nearest(ids, w, self.k, skip)

    def vote(self, at: np.ndarray, sims: np.ndarray) -> float:
        """The toxic share among the nearest, with one vote of the prior."""
        w = sims**2 * self.stands_for[at] / max(1.0, float(self.stands_for.min()))
        yes = float(w @ self.toxic[at])
        return (yes + PRIOR * self.prior) / (float(w.sum()) + PRIOR)

    def calibrate(self, sparse: list[tuple[np.ndarray, np.ndarray]]) -> None:
        near = [self.nearest(*v, skip=e) for e, v in enumerate(sparse)]
        votes = np.array([self.vote(*x) if len(x[0]) else -1.0 for x in near])
        none = votes < 0
        share = lambda m, base: float((self.stands_for[m] @ self.toxic[m] + base) / (self.stands_for[m].sum() + 1))
        self.empty_score = share(none, self.prior)
        order = np.argsort(votes[~none], kind="stable")
        x, y, w = votes[~none][order], self.toxic[~none][order].astype(float), self.stands_for[~none][order]
        pools: list[list[float]] = []  # value, weight, left edge, right edge
        for a, b, c in zip(x, y, w, strict=True):
            pools.append([b, c, a, a])
            while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] >= pools[-1][2]):
                v, u = pools.pop(), pools.pop()
                pools.append([(u[0] * u[1] + v[0] * v[1]) / (u[1] + v[1]), u[1] + v[1], u[2], v[3]])
        if pools:
            self.steps = np.array([e for p in pools for e in (p[2], p[3])]), np.array([p[0] for p in pools for _ in (0, 1)])

    def score(self, text: bytes | None) -> tuple[float, np.ndarray, np.ndarray]:
        """Score, nearest examples and their cosines; copies that a task meets again are not searched again."""
        key = xxhash.xxh3_128_digest(text or b"")
        if key not in self.seen:
            if len(self.seen) >= SEEN:
                self.seen.clear()
            self.seen[key] = self._score(text)
        return self.seen[key]

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def _score(self, text: bytes | None) -> tuple[float, np.ndarray, np.ndarray]:
        ids, w = self.vector(text)
        at, sims = self.nearest(ids, w) if len(ids) and self.steps is not None else (np.zeros(0, dtype=np.int64), np.zeros(0))
        return float(np.interp(self.vote(at, sims), *self.steps)) if len(at) else self.empty_score, at, sims


def fit(docs: DataFrame, labels: DataFrame, per_class: int = EXAMPLES, k: int = NEAREST) -> Model:
    """The index over a bounded sample of `labels`, with statistics of all `docs`."""
    small_batches(docs.sparkSession)
    sample, sizes = sample_labels(labels, per_class)
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [sorted(Counter(words(t.as_py())).items()) for t in batch.column(2)]
            cols = [pa.array([[p[i] for p in x] for x in c], pa.list_(kind)) for i, kind in ((0, pa.binary()), (1, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "toxic", "words", "n"])

    examples = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id")
    examples = examples.select(F.col("doc_id").cast("long"), "toxic", "text").mapInArrow(reduce, "doc_id long, toxic int, words array<binary>, n array<int>")
    # Of rows that repeat a doc_id one counts.
    examples = examples.groupBy("doc_id", "toxic").agg(F.min(F.struct("words", "n")).alias("x")).select("doc_id", "toxic", "x.words", "x.n")
    got = examples.toArrow()
    got = got.take(pc.sort_indices(got, [("doc_id", "ascending")]))
    toxic = got.column("toxic").to_numpy().astype(float)
    empty = Model({}, np.zeros(0), 0.0, np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0), k, prior, None, prior)
    if not 0 < toxic.sum() < len(toxic):
        return empty
    lists = got.column("words").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    term, size = coded.indices.to_numpy().astype(np.int64), lists.value_lengths().to_numpy()
    tf = 1 + np.log(got.column("n").combine_chunks().flatten().to_numpy())
    index = {w: i for i, w in enumerate(coded.dictionary.to_pylist())}
    ids = got.column("doc_id").to_numpy()
    del got, lists, coded  # the driver holds the index once
    pa.default_memory_pool().release_unused()
    df, total = document_frequencies(docs, index)
    held = [np.bincount(term, np.repeat(toxic == c, size), len(index)) for c in (0, 1)]
    weights = (np.log((total + 1) / (df + 1)) + 1) * telling(*held, int((toxic == 0).sum()), int(toxic.sum()))
    sparse = []
    for t, n in zip(np.split(term, np.cumsum(size)[:-1]), np.split(tf, np.cumsum(size)[:-1]), strict=True):
        w = n * weights[t]
        order = np.argsort(t)
        sparse.append((t[order], w[order] / max(np.sqrt(w @ w), 1e-300)))
    del term, tf, size, held, t, n
    # Examples that share their weightiest term lie together, so that blocks have telling maxima.
    first = np.array([t[w.argmax()] if len(t) else -1 for t, w in sparse])
    order = np.lexsort((np.arange(len(first)), first, toxic))
    toxic = toxic[order]
    stands_for = np.where(toxic == 1, sizes[1] / toxic.sum(), sizes[0] / (toxic == 0).sum())
    unknown = (np.log((total + 1) / 2) + 1) * FLOOR
    sparse = [sparse[i] for i in order]
    model = Model(index, weights, unknown, ids[order], toxic, stands_for, k, prior, index=Index.of(sparse, len(weights)))
    model.calibrate(sparse)
    return model


def share(docs: DataFrame, labels: DataFrame) -> Broadcast:
    """The fitted model, broadcast; the driver keeps no memory of it in Python."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    release()
    return shared


def score(docs: DataFrame, labels: DataFrame, cut_at: float = CUT, evidence: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted and the nearest examples (ids, cosines) of every row."""
    shared = share(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = [model.score(t.as_py()) for t in batch.column(2)]
            s = np.array([o[0] for o in out])
            near = pa.array([model.ids[o[1][:evidence]].tolist() for o in out], pa.list_(pa.int64()))
            sims = pa.array([o[2][:evidence].tolist() for o in out], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= cut_at).astype(np.int32)), near, sims], ["doc_id", "held_out", "score", "predicted", "evidence", "cosines"])

    rows = spread(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long"), (~train_fold(F.col("doc_id"))).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>, cosines array<double>")


def keep_clean(docs: DataFrame, labels: DataFrame, cut_at: float = CUT) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns."""
    shared = share(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [shared.value.score(t.as_py().encode("utf-8", "surrogatepass") if t.is_valid else None)[0] < cut_at for t in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
