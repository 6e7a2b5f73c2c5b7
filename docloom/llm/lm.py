r"""Language-model scoring by a hashed maximum-entropy model.

p(word | history) = p(group | history) p(class | group, history) p(word | class).
The first two factors are softmaxes over hashed features of the history: the
word before, the one before that (a skip), both, and the pair around a gap.  Classes are the end of the
text, the most frequent words one by one, and `SUFFIXES` groups of all other
words by a hash of their last two bytes.  Within a group a word has its share
of the group's counts, smoothed as in the base score.

Words are counted over all training texts (a shuffle by word).  The class
factor is trained by distributed gradient updates: each partition runs Adagrad
over its texts from the shared weights, and the partitions' changes are
averaged feature by feature, weighted by how often each has seen the feature.
Texts are then scored in sparse numpy batches.  Frequent words (`HEAD` at
most) are broadcast with their counts; occurrences of all other words meet
their counts in a join, summed by document before.

Tokens: A-Z in lower case, words `[^\x20\x09-\x0D]+`, then one end.

Defined results: null and empty texts are the end alone; a null doc_id counts
as a training row; repeated rows count and are scored each; without training
rows all counts are zero and the score equals that of an untrained softmax; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut, small_batches, spread

#: Most words that are broadcast; single-word classes; classes of the other words; rows of the weights.
HEAD = 1 << 17
SINGLES = 31
SUFFIXES = 32
FEATURES = 1 << 14
SMOOTH = 0.1
CLASSES = 1 + SINGLES + SUFFIXES
#: Classes are dealt into groups; each choice is among WIDE.  Every feature has a row of weights for each choice.
WIDE = 8
CHOICES = 1 + CLASSES // WIDE
N_FEATURES = 4
RATE = 0.5
ROUNDS = 1
_BATCH = 4096
_FLUSH = 1 << 18
_BEGIN = 0x9E3779B9
_END = 0x85EBCA6B


def train_fold(doc_id):
    """Rows that counts and weights are learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) != 0, F.lit(True))


def word_counts(texts: DataFrame) -> DataFrame:
    """Binary `text` -> (word, n) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update((text.as_py() or b"").lower().split())
                if len(held) > _FLUSH:
                    yield out()
                    held.clear()
        yield out()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    head: dict[bytes, int]  # word -> row of the arrays below
    hashes: np.ndarray
    classes: np.ndarray
    counts: np.ndarray
    class_log: np.ndarray  # log10 of each class's denominator; 0 for single words
    n: int
    v: int
    ends: int

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Hashes, classes, counts (-1: not in the head) and the words that are not in the head."""
        rows = np.fromiter(map(self.head.get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))
        h, c, n = self.hashes[rows], self.classes[rows], self.counts[rows]
        at = np.flatnonzero(rows < 0)
        rest = [words[i] for i in at.tolist()]
        if rest:
            h[at] = np.fromiter(map(crc32, rest), dtype=np.uint32, count=len(rest))
            c[at] = [1 + SINGLES + crc32(w[-2:]) % SUFFIXES for w in rest]
            n[at] = -1
        return h, c, n, rest


def lexicon(counts: DataFrame, ends: int, most: int = HEAD) -> Lexicon:
    """The frequent words and the totals of all classes, from the table of counts."""
    n = v = 0
    least = None
    if ends:
        # Word counts in eighths of a power of two: a bounded number of rows for any corpus.
        scale = F.floor(F.log2(F.col("n").cast("double")) * 8)
        for r in sorted(counts.groupBy(scale.alias("scale")).agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.min("n").alias("least")).collect(), key=lambda r: -r["scale"]):
            n, v = n + r["n"], v + r["v"]
            if v <= most:
                least = r["least"]
    rows = counts.where(F.col("n") >= least).collect() if least is not None else []
    rows = sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda r: (-r[1], r[0]))
    words = [w for w, _ in rows]
    classes = np.array([1 + SINGLES + crc32(w[-2:]) % SUFFIXES for w in words] + [0], dtype=np.int64)
    classes[: min(SINGLES, len(words))] = 1 + np.arange(min(SINGLES, len(words)))
    total, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    if ends:
        group = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(SUFFIXES))
        for r in counts.groupBy(group.alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            total[1 + SINGLES + r["g"]] += r["n"]
            kinds[1 + SINGLES + r["g"]] += r["v"]
        for w, k in rows[:SINGLES]:  # a class of their own
            total[1 + SINGLES + crc32(w[-2:]) % SUFFIXES] -= k
            kinds[1 + SINGLES + crc32(w[-2:]) % SUFFIXES] -= 1
    logs = np.log10(total + SMOOTH * (kinds + 1))
    logs[: 1 + SINGLES] = 0.0
    hashes = np.array([crc32(w) for w in words] + [0], dtype=np.uint32)
    return Lexicon({w: i for i, w in enumerate(words)}, hashes, classes, np.array([k for _, k in rows] + [0], dtype=np.int64), logs, n + ends, v + (ends > 0), ends)


def features(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of the weights for every token: h holds each text's words and end, one text after another."""
    padded = np.full(len(h) + 3 * len(starts), _BEGIN, dtype=np.uint64)
    at = np.arange(len(h)) + 3 * (np.repeat(np.arange(len(starts)), sizes) + 1)
    padded[at] = h
    a, b, c = (padded[at - k] for k in (1, 2, 3))
    mixed = (a * np.uint64(0x9E3779B1) + np.uint64(1), b * np.uint64(0x85EBCA77) + np.uint64(2), a * np.uint64(0xC2B2AE3D) + b * np.uint64(0x27D4EB2F) + np.uint64(3), a * np.uint64(0x165667B1) + c * np.uint64(0xD3A2646C) + np.uint64(4))
    return np.stack([((m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(FEATURES) for m in mixed], axis=1).astype(np.int32)


def choices(f: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two choices a token, all groups first: rows of the weights, number of the choice, what was chosen."""
    group = (c // WIDE).astype(np.int32)
    rows = f * np.int32(CHOICES)
    node = np.concatenate([np.zeros(len(f), dtype=np.int32), group + 1])
    return np.concatenate([rows, rows + group[:, None] + 1]), node, np.concatenate([group, (c % WIDE).astype(np.int32)])


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, node: np.ndarray) -> np.ndarray:
    z = bias.take(node, axis=0)
    for k in range(N_FEATURES):
        z += weights.take(rows[:, k], axis=0)
    np.clip(z, -40, 40, out=z)  # sums of exponentials stay finite
    z -= np.log(np.exp(z) @ np.ones((z.shape[1], 1), dtype=np.float32))
    return z


def log_classes(weights: np.ndarray, bias: np.ndarray, f: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Natural logarithm of each token's class given its history."""
    rows, node, chosen = choices(f, c)
    p = log_softmax(weights, bias, rows, node)[np.arange(len(rows)), chosen]
    return p[: len(f)].astype(np.float64) + p[len(f) :]


class Trainer:
    """Adagrad over the tokens of one partition, from shared weights."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.w, self.bias = weights.copy(), bias
        self.g2 = np.full(self.w.shape, 1e-2, dtype=np.float32)
        self.seen = np.zeros(len(weights), dtype=np.int64)

    def update(self, f: np.ndarray, c: np.ndarray) -> None:
        rows, node, chosen = choices(f, c)
        g = np.exp(log_softmax(self.w, self.bias, rows, node))
        g[np.arange(len(rows)), chosen] -= 1
        flat = rows.ravel()
        order = np.argsort(flat)
        ordered = flat.take(order)
        first = np.flatnonzero(np.diff(ordered, prepend=-1))
        at, n = ordered[first], np.diff(np.append(first, len(flat)))
        d = np.add.reduceat(g.take(order // N_FEATURES, axis=0), first, axis=0) / np.sqrt(n)[:, None].astype(np.float32)
        self.seen[at] += n
        g2 = self.g2.take(at, axis=0) + d * d
        self.g2[at] = g2
        self.w[at] -= RATE * d / np.sqrt(g2)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for batch in batches:
        yield batch, [(t.as_py() or b"").lower().split() for t in batch.column(column)]


def _encoded(lex: Lexicon, docs: list[list[bytes]]):
    """Hashes, classes, counts of all tokens with ends; each text's start and size; words beyond the head, per text."""
    sizes = np.array([len(d) + 1 for d in docs])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    h, c, n, rest = lex.encode([w for d in docs for w in (*d, b" ")])
    ends = starts + sizes - 1
    h[ends], c[ends], n[ends] = _END, 0, lex.ends
    return h, c, n, starts, sizes, [w for w in rest if w != b" "]


def train(texts: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The weights of the class factor, by rounds of distributed updates over all training texts."""
    sc = texts.sparkSession.sparkContext
    share = np.bincount(lex.classes[:-1], weights=lex.counts[:-1], minlength=CLASSES) + 1.0
    share[0] += lex.ends
    share[1 + SINGLES :] = 10 ** lex.class_log[1 + SINGLES :]
    share = share.reshape(-1, WIDE)
    bias = np.log(np.vstack([share.sum(axis=1) / share.sum(), share / share.sum(axis=1, keepdims=True)])).astype(np.float32)
    weights = np.zeros((FEATURES * CHOICES, WIDE), dtype=np.float32)
    columns = [f"c{i}" for i in range(WIDE)]
    schema = "feature int, seen long, " + ", ".join(f"{c} float" for c in columns)
    for _ in range(rounds if lex.ends else 0):
        shared = sc.broadcast((lex, weights, bias))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lex, weights, bias = shared.value
            trainer = Trainer(weights, bias)
            for _, docs in _texts(batches, 0):
                h, c, _, starts, sizes, _ = _encoded(lex, docs)
                f = features(h, starts, sizes)
                for i in range(0, len(f), _BATCH):
                    trainer.update(f[i : i + _BATCH], c[i : i + _BATCH])
            at = np.flatnonzero(trainer.seen)
            moved = (trainer.w[at] - weights[at]) * trainer.seen[at][:, None].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(trainer.seen[at]), *(pa.array(moved[:, k]) for k in range(WIDE))], ["feature", "seen", *columns])

        moved = texts.select("text").mapInArrow(run, schema).groupBy("feature").agg(F.sum("seen").alias("seen"), *(F.sum(c).cast("float").alias(c) for c in columns))
        got = moved.toArrow()
        at = got.column("feature").to_numpy()
        weights[at] += np.stack([got.column(c).to_numpy() for c in columns], axis=1) / got.column("seen").to_numpy()[:, None].astype(np.float32)
        shared.destroy()
    return weights, bias


_PART = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, log_p double, rest array<binary>, rest_n array<int>, rest_class array<int>"


def score(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of `docs`."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    rows = spread(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long"), (~train_fold(F.col("doc_id"))).alias("held_out"), F.col("text").cast("binary").alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = cut(word_counts(training), "lm-counts")
    lex = lexicon(counts, training.select("doc_id").count(), head)
    weights, bias = train(training, lex, rounds)
    base_log = float(np.log10(lex.n + SMOOTH * (lex.v + 1)))
    shared = spark.sparkContext.broadcast((lex, weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, weights, bias = shared.value
        for batch, texts in _texts(batches, 2):
            h, c, n, starts, sizes, rest = _encoded(lex, texts)
            f = features(h, starts, sizes)
            log_c = np.empty(len(f))
            for i in range(0, len(f), _BATCH):
                log_c[i : i + _BATCH] = log_classes(weights, bias, f[i : i + _BATCH], c[i : i + _BATCH])
            known = n >= 0
            log_n = np.where(known, np.log10(np.maximum(n, 0) + SMOOTH), 0.0)
            base = np.add.reduceat(log_n, starts) - sizes * base_log
            inside = np.where(c > SINGLES, log_n - lex.class_log[c], 0.0)
            log_p = np.add.reduceat(log_c / np.log(10) + inside, starts)
            # Words beyond the head: their counts come by a join.
            owner = np.repeat(np.arange(len(starts)), sizes)[~known]
            bounds = np.searchsorted(owner, np.arange(len(starts) + 1))
            cols: list[list] = [[], []]
            for k in range(len(starts)):
                own = Counter(rest[bounds[k] : bounds[k + 1]])
                cols[0].append(list(own))
                cols[1].append(list(own.values()))
            n_known = np.add.reduceat((n > 0).astype(np.int64), starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes.astype(np.int64)), pa.array(n_known), pa.array(base), pa.array(log_p), pa.array(cols[0], pa.list_(pa.binary())), pa.array(cols[1], pa.list_(pa.int32()))],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "log_p", "rest", "rest_n"],
            )

    parts = rows.mapInArrow(run, _PART.rsplit(", rest_class", 1)[0]).withColumn("row", F.monotonically_increasing_id())
    parts = cut(parts, "lm-scores")
    rest = parts.select("row", F.explode(F.arrays_zip(F.col("rest").alias("w"), F.col("rest_n").alias("k"))).alias("x")).select("row", F.col("x.w").alias("w"), F.col("x.k").alias("k"))
    met = rest.join(counts, rest["w"] == counts["word"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    more = met.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * F.log10(F.col("n") + F.lit(SMOOTH))).alias("more"))
    zero = F.lit(0.0)
    return parts.drop("rest", "rest_n").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(lex.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", zero)).alias("base_score"),
        (F.col("log_p") + F.coalesce("more", zero)).alias("score"),
    )


