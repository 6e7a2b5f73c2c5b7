"""The training-data operators against brute force, and on rows made to break them."""

import hashlib
import html
import math
import pickle
import random
import re
import tracemalloc
from collections import Counter
from pathlib import Path
from zlib import crc32

import numpy as np
import pytest
import xxhash

from docloom.llm import ann, chat, decontam, html_extract, lm, mixing, pii, simhash, toxicity, urlfilter
from docloom.llm.graph import stars
from docloom.session import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, row string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 0.5, "x") for i, t, s in rows], DOCS)


def prose(rng, n, size=400):
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 8))) for _ in range(size)]
    return " ".join(rng.choice(vocab) for _ in range(n))


ODD = [(None, None, None), (1, None, "a"), (2, "", "a"), (3, "\t\n ", None), (4, "one", "b"), (4, "one", "b"), (5, "two words", "b"), (6, "é" * 5000 + " " + "x" * 200_000, "c"), (7, "A b C d E", "a")]


# -- mixing ------------------------------------------------------------------


def test_targets_share_what_is_above_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and got["b"] == 300 and got[None] == 0
    assert got["c"] == pytest.approx(780)


def test_mix_meets_every_target_to_the_word(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)] + ODD
    docs = docs_of(spark, rows)
    got = mixing.mix_sources(docs, spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1)], "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        t = by.setdefault(r["source"], [r["target"], 0, 0])
        t[1] += r["taken"]
        t[2] += r["size"]
    assert all(abs(t[0] - t[1]) <= 1 for t in by.values())
    assert sum(t[0] for t in by.values()) == pytest.approx(sum(t[2] for t in by.values()))
    again = mixing.mix_sources(docs.repartition(5)).select("doc_id", "taken").collect()
    first = mixing.mix_sources(docs).select("doc_id", "taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, first))


# -- SimHash -----------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def test_fingerprints_and_groups_are_exact(spark):
    rng = random.Random(2)
    base = [prose(rng, rng.randrange(3, 80)) for _ in range(60)]
    texts = base + [b + " " + prose(rng, rng.randrange(0, 3)) for b in base] + [b[:-3] for b in base] + [t for _, t, _ in ODD if t]
    rows = [(100 + i, t, "s") for i, t in enumerate(texts)] + [(1, None, None), (2, "", "a"), (2, "", "a"), (None, "one", None)]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    known = [(i, t) for i, t, _ in rows if i is not None]
    fps = [plain_fingerprint(t) for _, t in known]
    roots = brute_components(fps)
    least = {}
    for (i, _), r in zip(known, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    want = Counter((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(known, fps, roots, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None) == want
    assert simhash.near_duplicates(docs_of(spark, [])).collect() == []


def test_shards_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(c) for c in centres] + [int(x) for x in rng.integers(0, 1 << 63, 2000, dtype=np.uint64)]
    for c in centres.tolist():
        x = c
        for _ in range(30):
            x ^= 1 << int(rng.integers(0, 63))
            fps.append(x)
    fps = sorted(set(fps))
    table = spark.createDataFrame([(x,) for x in np.array(fps, dtype=np.uint64).view(np.int64).tolist()], "fp long")
    got = {r["a"]: r["b"] for r in simhash.link(table, shard=64, sample=1024).collect()}
    assert got == {r["a"]: r["b"] for r in simhash.link(table, shard=24, sample=40).collect()}  # shards that are split again
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    roots = brute_components(fps)
    groups = {}
    for f, r in zip(signed, roots, strict=True):
        groups.setdefault(r, []).append(f)
    assert got == {f: min(g) for g in groups.values() for f in g if f != min(g)}


def test_index_of_examples_needs_little_memory():
    rng = np.random.default_rng(1)
    sparse = [(np.sort(rng.choice(20_000, 1000, replace=False)), rng.random(1000)) for _ in range(500)]
    tracemalloc.start()
    index = toxicity.Index.of(sparse, 20_000, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert index.posting.nbytes == 8 * 500_000
    assert (index.row >= 0).any()
    assert peak < 40 * 500_000  # bytes a posting; 50 where numbers of 64 bits were kept to the end


def test_a_fingerprint_has_one_copy_a_mask(spark, monkeypatch):
    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    near = np.setdiff1d(fps[:200] ^ np.uint64(1 << 5 | 1 << 41), fps)
    table = spark.createDataFrame([(x,) for x in np.concatenate([fps, near]).view(np.int64).tolist()], "fp long")
    sizes, real = [], simhash.cut

    def counted(df, tag, *spent):
        out = real(df, tag, *spent)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash, "cut", counted)
    got = {frozenset((r["a"], r["b"])) for r in simhash.link(table, shard=64).collect()}
    assert got == {frozenset(p) for p in zip(near.view(np.int64).tolist(), fps[:200].view(np.int64).tolist(), strict=True)}
    assert max(sizes) == (len(fps) + len(near)) * (simhash.RADIUS + 1)


def test_shards_that_agree_on_a_mask(spark):
    dense = np.arange(4096, dtype=np.uint64) << np.uint64(52)  # 12 bits vary
    table = spark.createDataFrame([(x,) for x in dense.view(np.int64).tolist()], "fp long")
    least = int(dense.view(np.int64).min())
    want = {x: least for x in dense.view(np.int64).tolist() if x != least}
    assert {r["a"]: r["b"] for r in simhash.link(table, shard=24, sample=40).collect()} == want
    label = simhash.local_stars(dense, 1, simhash.RADIUS)  # all agree on the lowest bit
    assert (label == 0).all()


def test_stars_at_once_and_in_rounds(spark):
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, int(x)) for x in rng.integers(101, 200, 80)] + [(-5, 7), (300, 300)]
    table = spark.createDataFrame(edges, "a long, b long")
    at_once, rounds = ({(r["a"], r["b"]) for r in stars(table, at_once=n).collect()} for n in (1000, 0))
    assert at_once == rounds
    assert {b for _, b in rounds} == {-5, 100}
    assert stars(table.limit(0)).count() == 0


def test_keep_one(spark):
    rows = [(5, "a b c d e f", "s"), (3, "a b c d e f", "s"), (3, "a b c d e f", "s"), (9, "quite another text it is", "s"), (None, "z z z", "s")]
    kept = simhash.keep_one(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [3, 9, None]
    rows = [(1, "b b b b b", "s"), (5, "b b b b b", "s"), (5, "quite another text it is", "s"), (None, "b b b b b", "s"), (7, None, "s"), (8, "", "s")]
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs_of(spark, rows)).collect()) == [(1, "b b b b b"), (5, "quite another text it is"), (7, None)]
    odd = spark.createDataFrame([(1, "a b c", {"k": 1}, 7), (2, "a b c", None, 8)], "doc_id long, text string, fp map<string,int>, row long")
    assert [(r["doc_id"], r["fp"], r["row"]) for r in simhash.keep_one(odd).collect()] == [(1, {"k": 1}, 7)]
    assert simhash.keep_one(docs_of(spark, [])).count() == 0


# -- decontamination ---------------------------------------------------------


def test_benchmark_passages_are_found_and_clean_texts_are_left(spark):
    rng = random.Random(4)
    size = 4000
    odd = [(900 + k, t, s) for k, (_, t, s) in enumerate(ODD)] + [(None, "one", "s")]
    items = [prose(rng, n, size) for n in (5, 15, 40, 90, 33)]
    rows = [(i, prose(rng, rng.randrange(5, 300), size), "s") for i in range(120)]
    leaks = {}
    for i in range(0, 100, 4):
        k = (i // 4) % len(items)
        words = items[k].split()
        if k >= 2 and i % 8:
            words = [w for w in words if rng.random() > 0.1]
        host = rows[i][1].split()
        at = rng.randrange(len(host))
        rows[i] = (i, " ".join(host[:at] + words + host[at:]).upper() if i % 12 == 0 else " ".join(host[:at] + words + host[at:]), "s")
        leaks[i] = k
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(50, None), (51, ""), (None, "x y z")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs_of(spark, rows + odd), bench).collect()}
    assert got == set(leaks.items())
    kept = decontam.keep_uncontaminated(docs_of(spark, rows + odd), bench)
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == Counter(i for i, _, _ in rows + odd if i not in leaks)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs_of(spark, rows[:3]), none).count() == 0
    assert decontam.contaminated(docs_of(spark, []), bench).count() == 0


def test_exact_copies_are_found_in_a_large_benchmark_of_long_items(spark):
    rng = random.Random(14)
    pool = prose(rng, 20_000, 20_000).split()
    text = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [text(100) for _ in range(2000)]
    rows = []
    for i in range(300):
        n = (100, 50)[i % 2]
        at = rng.randrange(101 - n)
        rows.append((i, " ".join(text(rng.randrange(60)) + items[i * 6][at : at + n] + text(rng.randrange(60))), "s"))
    clean = [(1000 + i, " ".join(text(150)), "s") for i in range(100)]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs_of(spark, rows + clean), bench).collect()]
    assert Counter(got) == Counter((i, i * 6) for i, _, _ in rows)


def test_windows_are_compared_by_true_cosine():
    rng = np.random.default_rng(22)
    bags = [rng.integers(0, 12, 32) for _ in range(6)]
    name = lambda t: b"w%02d" % t
    items = decontam.Items({name(t): t for t in range(8)}, [0], [bags[0] % 8], [np.zeros(0, np.int64)], [(0, 0, 32)])
    idf = np.append(rng.random(8) + 0.5, 0.7)
    vector = lambda w: np.bincount(w, minlength=12) * np.where(np.arange(12) < 8, idf[np.minimum(np.arange(12), 8)], 0.7)
    p = vector(bags[0] % 8)
    space = decontam.Space(0, np.append(np.arange(8), 8).astype(np.int32), np.vstack([np.diag(idf[:8]), np.zeros((1, 8))]).astype(np.float32), (p[:8] / np.linalg.norm(p))[None].astype(np.float32), np.array([0.01], np.float32))
    found = {}
    matcher = decontam.Matcher(items, idf, [space])
    matcher._check = lambda doc, c: found.setdefault(len(found), c) and []
    texts = [bags[0] % 8, *bags[1:], np.zeros(32, np.int64)]
    matcher.match([b" ".join(map(name, t.tolist())) for t in texts])
    for t, c in zip(texts, found.values(), strict=True):
        v = vector(t)
        assert [x[0] for x in c] == pytest.approx([p @ v / np.linalg.norm(p) / np.linalg.norm(v)], abs=1e-5)
    assert found[0][0][0] == pytest.approx(1, abs=1e-5)


def test_paraphrases_are_found_and_items_without_id_count(spark):
    rng = random.Random(23)
    pool = prose(rng, 8000, 8000).split()
    text = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [text(40) for _ in range(100)]
    rows = [(i, " ".join(text(40) + [w if rng.random() > 0.3 else rng.choice(pool) for w in t] + text(40)), "s") for i, t in enumerate(items)]
    clean = [(1000 + i, " ".join(text(120)), "s") for i in range(100)]
    bench = spark.createDataFrame([(k if k else None, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs_of(spark, rows + clean), bench).collect()}
    assert got <= {(k, k if k else None) for k in range(100)} and len(got) >= 93
    copies = docs_of(spark, [(1, " ".join(items[0]), "s"), (2, " ".join(items[5]), "s"), (3, None, None)])
    assert [r["doc_id"] for r in decontam.keep_uncontaminated(copies, bench).collect()] == [3]
    assert decontam.keep_uncontaminated(copies, bench.limit(0)).count() == 3 and decontam.keep_uncontaminated(copies.limit(0), bench).count() == 0


def test_answer_column_lowers_what_must_be_covered():
    a, b = np.arange(10), np.array([0, 1, 2, 99, 3, 98, 4, 97, 96, 95])
    weight = np.ones(100)
    assert decontam.covered(a, b, weight) == pytest.approx(0.5)
    assert decontam.covered(a, a[::-1], weight) == pytest.approx(0.1)
    assert decontam.holds(a[2:5], a) and not decontam.holds(np.array([2, 4]), a)


def test_randomised_svd_finds_the_leading_space(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 30))
    rows = [(list(range(30)), r.tolist()) for r in a]
    v = decontam.randomised_svd(spark.createDataFrame(rows, "ids array<int>, weights array<double>"), 30, 5)
    assert np.allclose(a @ v @ v.T, a, atol=1e-6)


# -- toxicity ----------------------------------------------------------------


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(6)
    vocab = prose(rng, 300).split()
    bad = ["grumblex", "snarvous", "blightful"]
    rows, labels = [], []
    for i in range(800):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 60))]
        toxic = int(i % 5 == 0)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "ly", "s"])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, toxic))
    ids = [(10_000 + k, t, s) for k, (_, t, s) in enumerate(ODD)]
    table = spark.createDataFrame(labels + [(None, 1), (3, None), (999_999, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs_of(spark, rows + ids + [(None, "one", "s")]), table).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [i for i, _ in labels if crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i]["held_out"] for i in held) and sum(r["held_out"] for r in got.values() if r["doc_id"] is not None and r["doc_id"] < 10_000) == len(held)
    assert sum(got[i]["predicted"] == int(i % 5 == 0) for i in held) >= 0.97 * len(held)
    kept = toxicity.keep_clean(docs_of(spark, rows), table)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in labels if not got[i]["predicted"]}
    assert toxicity.score(docs_of(spark, []), table).count() == 0
    one_class = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs_of(spark, rows[:5]), one_class).collect()} == {0.0}


def test_block_max_search_is_exact():
    rng = np.random.default_rng(7)
    n, v = 500, 60
    dense = np.where(rng.random((n, v)) < 0.1, rng.random((n, v)), 0)
    dense[:20] = dense[20:40]
    sparse = []
    for r in dense:
        at = np.flatnonzero(r)
        sparse.append((at, r[at] / max(np.linalg.norm(r), 1e-9)))
    full = np.zeros((v, n))
    for e, (t, w) in enumerate(sparse):
        full[t, e] = w
    for frequent in (1, 45, 50, 1000):
        index = toxicity.Index.of(sparse, v, frequent)
        for _ in range(30):
            q = np.where(rng.random(v) < 0.15, rng.random(v), 0)
            ids = np.flatnonzero(q)
            w = q[ids] / max(np.linalg.norm(q), 1e-9)
            sims = w @ full[ids]
            want = [i for i in np.lexsort((np.arange(n), -sims))[:10] if sims[i] > 0]
            at, got = index.nearest(ids, w, 10)
            assert np.allclose(got, sims[want], atol=1e-6) and len(at) == len(want)


def test_lists_are_gathered_without_a_copy_and_maxima_are_bounds():
    rng = np.random.default_rng(3)
    sparse = []
    for _ in range(300):
        at = np.flatnonzero(rng.random(40) < 0.5)
        sparse.append((at, rng.random(len(at))))
    index = toxicity.Index.of(sparse, 40, 150)
    assert 0 < len(index.most) < 40
    for e, (at, w) in enumerate(sparse):
        often = index.row[at] >= 0
        assert (index.most[index.row[at[often]], e // toxicity.BLOCK] >= w[often].astype(np.float32)).all()  # as weights are kept
    before = len(pickle.dumps(index))
    assert index.nearest(*sparse[5], 1)[0].tolist() == [int(np.argmax([sum(dict(zip(*x, strict=True)).get(t, 0) * v for t, v in zip(*sparse[5], strict=True)) for x in sparse]))]
    assert index.lists.buffers()[2].address == index.posting.ctypes.data
    assert len(pickle.dumps(index)) == before
    for t in np.flatnonzero(index.row < 0):
        at = np.frombuffer(index.lists[t].as_py(), dtype=np.int32).reshape(-1, 2)
        assert at[:, 0].tolist() == [e for e, x in enumerate(sparse) if t in x[0]]


def test_words_are_counted_once_a_document(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(0, 60), 50) for _ in range(200)] + [None, ""]
    index = {w.encode(): i for i, w in enumerate(sorted({w.lower() for t in texts if t for w in t.split()})[::2])}
    df, n = toxicity.document_frequencies(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), index)
    want = [sum(w in set(toxicity.words((t or "").encode())) for t in texts) for w in index]
    assert n == len(texts) and df.tolist() == want


def test_evidence_equals_brute_force_over_all_terms(spark):
    rng = random.Random(16)
    rows = [(i, prose(rng, rng.randrange(0, 40), 80) + (" vile" if i % 4 == 0 else ""), "s") for i in range(150)]
    table = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs_of(spark, rows), table, evidence=16).collect()}
    bags = {i: Counter(t.lower().split()) for i, t, _ in rows}
    df = Counter(w for b in bags.values() for w in b)
    examples = [i for i in range(100) if crc32(str(i).encode()) % 4 != 2]
    held = {c: Counter(w for i in examples if (i % 4 == 0) == c for w in bags[i]) for c in (0, 1)}
    sizes = {c: sum((i % 4 == 0) == c for i in examples) for c in (0, 1)}

    def weight(w):
        idf = math.log((len(rows) + 1) / (df[w] + 1)) + 1
        if not held[0][w] + held[1][w]:
            return (math.log((len(rows) + 1) / 2) + 1) * toxicity.FLOOR
        return idf * float(toxicity.telling(np.array([held[0][w]]), np.array([held[1][w]]), sizes[0], sizes[1])[0])

    def unit(b):
        x = {w: (1 + math.log(n)) * weight(w) for w, n in b.items()}
        z = math.sqrt(sum(v * v for v in x.values())) or 1
        return {w: v / z for w, v in x.items()}

    units = {i: unit(b) for i, b in bags.items()}
    for i, _, _ in rows:
        sims = sorted((s for e in examples if (s := sum(v * units[e].get(w, 0) for w, v in units[i].items())) > 0), reverse=True)[:16]
        assert np.allclose(sims, got[i]["cosines"], atol=1e-6)
        for e, s in zip(got[i]["evidence"], got[i]["cosines"], strict=True):
            assert sum(v * units[e].get(w, 0) for w, v in units[i].items()) == pytest.approx(s, abs=1e-6)


# -- personal data -----------------------------------------------------------


def plain_spans(text):
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    parts = ["a", "b.", "@", "1", "2", "9", ".", "-", " ", "+", "(", ")", "4111111111111111", "x@y.z", "10.", "255", "é", "٣", "\n"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))
        assert pii.base_spans(text) == plain_spans(text), text
        base, wide, bc, wc = pii.scan(text)
        assert len(base) == len(bc) and len(wide) == len(wc)
        assert all(e <= s2 or e2 <= s for _, s, e in wide for _, s2, e2 in base)


def test_find_and_redact(spark):
    text = "mail to jo@site.org or call 415-555-0132 from 10.2.3.4, card 4111 1111 1111 1111, tel +1 (415) 555-0132."
    rows = [(i, text, "s") for i in range(20)] + ODD
    got = pii.find_pii(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    r = next(r for r in got if r["spans"])
    base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in plain_spans(text))
    assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert set(base.split(",")) <= set(r["spans"].split(","))
    assert "phone:28:40" in r["spans"]
    clean = pii.redact(docs_of(spark, rows))
    assert clean.columns == docs_of(spark, rows).columns
    found = [r["text"] for r in clean.collect()]
    assert "mail to [EMAIL] or call [PHONE] from [IP], card [CARD], tel [PHONE]." in found
    assert Counter(t for _, t, _ in ODD) <= Counter(found)
    assert pii.find_pii(docs_of(spark, [])).count() == 0


# -- HTML --------------------------------------------------------------------

PAGE = '<!DOCTYPE html><html><head><title>t</title><script>var a="</p>"</script></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div><div class="sidebar">side {n}</div>{main}<section id="comments"><p>nice {n}</p></section><footer>&copy; us</footer></body></html>'


def test_main_text_of_pages_of_one_template(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for n in range(30):
        paras = [prose(rng, 30) + " &amp; x" for _ in range(rng.randrange(1, 4))]
        body = "<h1>Title  {}</h1>".format(n) + "".join(f"<p><b>{p}<br>line" for p in paras) + '<form><input><button>send</button></form><div class="share">Share</div>'
        main = f"<article>{body}</article>" if n % 2 else f'<div class="post">{body}</div>'
        host = "a.example.com" if n % 2 else "b.example.com"
        rows.append((n, f"https://{host}/{n}", PAGE.replace("{main}", main).replace("{n}", str(n))))
        want[n] = " ".join([f"Title {n}"] + [" ".join((html.unescape(p) + " line").split()) for p in paras])
    rows += [(100, None, None), (101, "https://c/", ""), (102, "https://c/", "just text"), (102, "https://c/", "just text"), (103, "https://d/", "<article><p>cut <b>of"), (104, "https://d/", "<div>" * 5000 + "deep")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, n int")
    got = html_extract.extract(pages).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {n: texts[n] for n in want} == want
    assert (texts[100], texts[101], texts[102], texts[103], texts[104]) == ("", "", "just text", "cut of", "deep")
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_what_a_class_must_say_and_depth(spark):
    kept = ["share-price", "notice-board", "social-history", "ad-hoc", "widget-guide", "promo-code-history", "comment-body"]
    rows = [(i, f"https://h{i}/", f'<main><p>before</p><div class="{c}">real content</div><p>after</p></main>') for i, c in enumerate(kept)]
    gone = ["ad", "cookie-notice", "comments", "socialShare x", "post share"]
    rows += [(20 + i, f"https://g{i}/", f'<main><p>before</p><div class="{c}">noise</div><p>after</p></main>') for i, c in enumerate(gone)]
    rows += [(40, "https://deep/", "<div>" * 260 + "<nav>MENU</nav><p>text</p>" + "</div>" * 260), (41, "https://deep2/", "<div><section>" * 700 + "<main><p>a</p><form>no</form></main>")]
    rows += [(42, "https://odd/", '<div class="notice-board"><p>board</p></div><div class="body"><p>' + "long text " * 20 + "</p></div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert all(got[i] == "before real content after" for i in range(len(kept)))
    assert all(got[20 + i] == "before after" for i in range(len(gone)))
    assert got[40] == "text" and got[41] == "a" and got[42] == ("long text " * 20).strip()


def test_templates_equal_occurrence_vectors_by_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for i in range(60):
        parts = [f'<div class="c{k}">x</div>' * rng.choice([1, 1, 1, 0, 2]) for k in range(4)] + ['<div class="always"><ul><li>m</li></ul></div>', "<p>a</p>" * rng.randrange(4)]
        rows.append((i, f"https://{rng.choice('aab')}/{i}", f"<html><body>{''.join(parts)}</body></html>"))
    rows.append(rows[0])
    parsed = html_extract.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {(r["host"], r["path"]) for r in html_extract.templates(parsed).collect()}
    want = set()
    for host in "ab":
        tags = [html_extract.parse(h)[0] for _, u, h in rows if u.split("/")[2] == host]
        vectors = {}
        for path in set().union(*tags):
            vectors.setdefault(tuple(t.get(path, 0) for t in tags), []).append(path)
        for v, paths in vectors.items():
            if len(paths) >= 2 and max(v) == 1 and sum(v) >= len(tags) / 2:
                want |= {(host, p) for p in paths}
    assert got == want and want


# -- language model ----------------------------------------------------------


def test_counts_and_base_scores(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randrange(0, 50), 60), "s") for i in range(200)] + ODD
    got = lm.score(docs_of(spark, rows), head=40).collect()
    words = lambda t: (t or "").encode().lower().split()
    trains = lambda i: i is None or crc32(str(i).encode()) % 10 != 0
    c = Counter(w for i, t, _ in rows if trains(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, _ in rows:
        tokens = [*words(t), None]
        want[(i, len(tokens), sum(c[w] > 0 for w in tokens), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), 6))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score(docs_of(spark, [])).count() == 0


def test_context_is_learnt(spark):
    rng = random.Random(11)
    pairs = {w: prose(rng, 3, 50).split() for w in prose(rng, 40, 40).split()}
    rows = [(i, " ".join(f"{w} {rng.choice(pairs[w])}" for w in rng.choices(list(pairs), k=40)), "s") for i in range(300)]
    held = [r for r in lm.score(docs_of(spark, rows)).collect() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_class_factor_sums_to_one():
    rng = np.random.default_rng(12)
    w = rng.normal(size=(lm.FEATURES * lm.CHOICES, lm.WIDE)).astype(np.float32)
    f = rng.integers(0, lm.FEATURES, (20, lm.N_FEATURES)).astype(np.int32)
    bias = np.zeros((lm.CHOICES, lm.WIDE), np.float32)
    total = sum(np.exp(lm.log_classes(w, bias, f, np.full(20, c))) for c in range(lm.CLASSES))
    assert np.allclose(total, 1, atol=1e-5)


def test_words_sum_to_one_after_any_history(spark):
    rng = random.Random(24)
    rows = [(i, prose(rng, 30, 90), "s") for i in range(60)]
    texts = docs_of(spark, rows).selectExpr("cast(text as binary) as text")
    counts = lm.word_counts(texts)
    lex = lm.lexicon(counts, len(rows), 50)
    weights, bias = lm.train(texts, lex)
    words = {bytes(r["word"]): r["n"] for r in counts.collect()}
    for history in (b"", rows[0][1].encode(), b"never seen before"):
        # Every word of the lexicon after the history, the end, and one unknown word for each group of words.
        docs = [[*history.split(), w] for w in words]
        h, c, _, starts, sizes, _ = lm._encoded(lex, [*docs, history.split()])
        last = np.append(starts[:-1] + sizes[:-1] - 2, starts[-1] + sizes[-1] - 1)
        p_class = np.exp(lm.log_classes(weights, bias, lm.features(h, starts, sizes)[last], c[last]))
        own = np.array([words.get(d[-1], 0) for d in docs] + [0])
        inside = np.where(c[last] > lm.SINGLES, (own + lm.SMOOTH) / 10 ** lex.class_log[c[last]], 1.0)
        f = np.repeat(lm.features(h, starts, sizes)[last[-1:]], lm.CLASSES, axis=0)
        every = np.exp(lm.log_classes(weights, bias, f, np.arange(lm.CLASSES)))
        unknown = (every[1 + lm.SINGLES :] * lm.SMOOTH / 10 ** lex.class_log[1 + lm.SINGLES :]).sum()
        assert (p_class * inside).sum() + unknown == pytest.approx(1, abs=1e-3)


def test_held_out_documents_gain_over_single_words(spark):
    got = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


# -- chat, URLs --------------------------------------------------------------


def test_every_speaker_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, None, "x"), (None, 0, "ann", "alone"), (2, 0, "system", "only"), (1, 1, "ann", "hi <|im_end|>")]
    turns = spark.createDataFrame([(*r, "zz") for r in rows], "conv_id long, turn long, role string, text string, name string")
    got = chat.rotate_perspectives(turns).collect()
    assert len(got) == 5 * 3 + 1
    assert {r["perspective"] for r in got if r["conv_id"] == 1} == {"ann", "bob", "unknown"}
    for r in got:
        assert r["rendered"].count("<|im_end|>") == 1 and r["trained"] == (r["role"] == "assistant")
        body = r["rendered"][r["mask_start"] : r["mask_end"]]
        assert body.endswith("<|im_end|>") if r["trained"] else body == ""
    assert chat.rotate_perspectives(turns.limit(0)).count() == 0


def test_automaton_equals_regular_expressions():
    rng = random.Random(13)
    for _ in range(300):
        globs = ["".join(rng.choice("ab/.*~?") for _ in range(rng.randrange(1, 40))) for _ in range(6)]
        texts = ["".join(rng.choice("ab/.é") for _ in range(rng.randrange(0, 30))) for _ in range(20)] + ["a" * 5000 + "b"]
        got = urlfilter.WildcardAutomaton(globs).match(texts)
        for j, g in enumerate(globs):
            pattern = re.compile("".join({"*": "(?s:.*)", "~": "[^/]*", "?": "(?s:.)"}.get(c, re.escape(c)) for c in re.sub(r"[*~]*\*[*~]*", "*", g)))
            for i, t in enumerate(texts[:-1]):
                assert got[i, j] == bool(pattern.fullmatch(t)), (g, t)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "https://EXAMPLE.com/en/x?q#f", "http://www.example.com/en/", "http://a.www.example.com/en/", "http://notexample.com/en/", "http://x.net/es/", "http://x.net/EN/", "http://example.com", "http://x.org/a.exe", "http://h/" + "a" * 100_000]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages).collect()}
    assert [got[i][1] for i in range(len(urls))] == [None, None, None, "example.com/en/", "www.example.com/en/", "www.example.com/en/", "com/", "net/es/", None, None, None, None]
    assert [got[i][2] for i in range(3, 12)] == ["block", "allow", "allow", "allow", "block", "allow", "allow", "block", "allow"]
    assert got[3][0] == "example.com" and got[0][0] == ""
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0


# -- nearest neighbours ------------------------------------------------------


def test_recall_ties_and_rows_that_take_no_part(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(600, 16))
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)]
    rows += [(700, None), (720, [0.0] * 16), (740, [float("nan")] + [1.0] * 15), (760, [1.0] * 3), (None, [1.0] * 16), (780, [None] + [1.0] * 15), (40, [float(v) for v in x[40]])]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, label int, score double")
    got = ann.nearest(table).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 600, 20))
    hits = 0
    for q, found in by.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:20]
        assert len({v for v, _ in found}) == len(found) == 20
        assert all(abs(score - x[v] @ x[q]) < 1e-9 for v, score in found)
        hits += len({v for v, _ in found} & set(want.tolist()))
    assert hits >= 0.97 * 20 * len(by)
    assert [v for v, _ in by[100]][:20] == list(range(101, 121))
    assert ann.nearest(table.limit(0)).count() == 0
    few = ann.nearest(table.where("vec_id in (20, 21, 22)")).collect()
    assert sorted(r["vec_id"] for r in few) == [21, 22]


def unit_rows(n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def recall(got, x, every=20):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q in range(0, len(x), every):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(by[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    return np.mean(hits)


@pytest.mark.parametrize("scale", [1.0, 1e100, 1e-100])
def test_recall_over_many_cells_and_parts_at_any_scale(spark, scale):
    x = unit_rows(3000, 32, 15) * scale
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = ann.nearest(table, ef=96, cell=100, trees=3, part=200, most=2000).collect()
    assert recall(got, x / scale) > 0.95


def test_slices_of_a_round_are_merged_at_once(spark, monkeypatch):
    x = np.random.default_rng(12).normal(size=(1200, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    vectors = ann.as_vectors(ann.as_nodes(ann.read_vectors(table), 5), 1.0, 6).localCheckpoint()
    tags, real = [], ann.cut

    def cut(df, tag, *spent):
        tags.append(tag)
        return real(df, tag, *spent)

    def lists(slices, at_once):
        graph = ann.build_graph(vectors, len(x), 16, 6, cell=100, trees=2, rounds=0)
        tags.clear()
        graph = ann.descend(graph, 6, ann.K, ann.SAMPLED, ann.OFFERS, slices, at_once)
        return {r["node"]: (r["others"], r["fresh"]) for r in graph.collect()}

    monkeypatch.setattr(ann, "cut", cut)
    want = lists(1, 1 << 30)
    assert any(any(f) for _, f in want.values())
    assert lists(4, 1 << 30) == want  # what slices offer is judged by the same lists
    assert tags.count("ann-offers") == 4 and tags.count("ann-graph") == 1
    got = lists(4, 1)
    assert tags.count("ann-graph") == 4 and got.keys() == want.keys()


def test_graph_rounds_go_on_until_it_is_settled(spark):
    x = unit_rows(3000, 32, 15)
    nodes = spark.createDataFrame([(i, v.astype("<f8").tobytes()) for i, v in enumerate(x)], "node long, vec binary")
    vectors = ann.as_vectors(nodes, 1.0, 15)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    best = np.argsort(-s, axis=1)[:, :20]
    edges = ann.build_graph(vectors, len(x), 32, 15, cell=100, trees=2)
    got = {r["node"]: set(r["others"]) for r in edges.collect()}
    assert np.mean([int(j) in got[i] for i in range(len(x)) for j in best[i]]) > 0.95


def test_a_search_in_slices_leaves_nothing_behind_and_finds_as_much(spark, monkeypatch):
    x = unit_rows(1200, 16, 19)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    folder = Path(shared_dir(spark)) / "docloom" / spark.sparkContext.applicationId
    before, seen = set(folder.glob("*")), []

    def cut(df, tag, *spent, real=ann.cut):
        out = real(df, tag, *spent)
        seen.append(Counter(p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before))
        return out

    monkeypatch.setattr(ann, "cut", cut)
    got = ann.nearest(table, every=2, cell=100, trees=3, part=200, at_once=1 << 20, together=1).collect()
    most = Counter()
    for held in seen:
        most |= held
    assert most["ann-graph"] == most["ann-state"] == most["ann-wanted"] == most["ann-found"] == 1  # the tables that a round replaces are gone
    assert most["ann-links"] > 1 and most["ann-scored"] > 1  # slices and searches
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before} == {"ann-queries", "ann-scored"}
    assert recall(got, x, every=2) > 0.95


def test_lengths_and_hubs(spark):
    x = unit_rows(800, 16, 17) * np.random.default_rng(18).lognormal(0, 3, 800)[:, None]
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(2000 + 20 * i, [float(i + 1), 1.0, 2.0]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(table, cell=100, trees=3, part=100).collect()
    assert recall([r for r in got if r["query_id"] < 800], x) > 0.9
    short = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 2000]
    assert short == [2000 + 20 * i for i in range(29, 9, -1)]


# -- the pipeline ------------------------------------------------------------


def test_pipeline_over_nulls_copies_and_leaks(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(31)
    vocab = prose(rng, 3000, 3000).split()
    text = lambda n, extra=(): " ".join(rng.sample(vocab, n) + list(extra))
    item = text(40)
    rows = [(i, text(60, ["grumblex", "snarvous"] if i % 5 == 0 else ()), "a") for i in range(300)]
    rows += [(400, rows[1][1], "b"), (401, rows[1][1], "b"), (401, text(50), "b"), (402, text(30) + " " + item + " " + text(30), "c"), (403, text(40) + " mail jo@site.org", "c"), (404, None, None), (405, "", "c"), (None, text(45), "c")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), {"k": 1}, 7) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, fp map<string,int>, row long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    toxic = {i for i in range(0, 300, 5)}
    # Of the copies of document 1 one stays, of 401 the other text; 404 and 405 are both wordless.
    want = Counter([i for i in range(300) if i not in toxic] + [401, 403, 404, None])
    assert Counter(r["doc_id"] for r in got) == want
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
