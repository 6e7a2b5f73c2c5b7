r"""Personal data by weak supervision.

Every whole text is scanned once for candidates of four kinds.  Base spans
(strict patterns) always stay.  Wider candidates - written-out addresses,
telephone numbers without a country code, shorter card numbers - are added
where the final classifier accepts them.

Labelers vote on each candidate (yes, no, abstain): its pattern, a gazetteer
(top-level domains, country and area codes, card prefixes, address blocks),
the words around it, a checksum or length test, and other candidates nearby.
Expectation-maximisation estimates each labeler's reliability per kind without
labels, from the counts of vote patterns over all documents; its posteriors
are the soft labels that a logistic span classifier is trained on.  Patterns
are few (a code of small integers), so what reaches the driver is bounded
however many documents there are, while the counts cover all of them.

All scans are linear in the length of a text.

Defined results: null text counts as empty; no span gives the empty string and
the SHA-256 of it; repeated rows are scanned each on its own; a null doc_id
stays null; an empty table gives an empty result; other columns are ignored.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut, small_batches, spread

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WRITTEN = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\.)[A-Za-z0-9-]{1,63}){1,4}", re.I)
_PLAIN_PHONE = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9]{2,5}\)?[\x20./-][0-9]{2,5}[\x20./-][0-9]{2,6}(?:[\x20./-][0-9]{2,6})?(?![0-9A-Za-z])")

#: Gazetteers and trigger words.
TLDS = frozenset("com org net edu gov int info biz io co eu de fr es uk us it nl ch at be pl pt se no fi dk ie ca mx br ar cl ru ua cn jp kr in au nz za".split())
COUNTRY_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "354", "358", "380", "420", "421", "852", "886", "971", "972")
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "36", "38", "30", "35", "60", "62", "64", "65")
TRIGGERS = (
    frozenset("mail email e-mail contact write address correo courriel reply".split()),
    frozenset("ip host server address addr client login from peer".split()),
    frozenset("card visa mastercard amex credit debit payment tarjeta carte karte pan".split()),
    frozenset("phone tel telephone call mobile cell fax telefon telefono contact whatsapp".split()),
)
AGAINST = frozenset("version v isbn issn doi order invoice part serial build chapter page figure section article".split())
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end): leftmost, non-overlapping for each kind."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        right = _DOMAIN.match(text, at + 1) if at >= last else None
        if right:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = right.end()
                found.append((EMAIL, start, last))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")):
                found.append((IP, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((CARD, m.start(), m.end()))
        if "+" in text:
            found += [(PHONE, m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], s[0]))


def wide_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that no base span overlaps."""
    more = []
    if "at" in text or "AT" in text or "At" in text:
        more += [(EMAIL, m.start(), m.end()) for m in _WRITTEN.finditer(text)] if ("(" in text or "[" in text) else []
    if _DIGIT.search(text):
        more += [(PHONE, m.start(), m.end()) for m in _PLAIN_PHONE.finditer(text) if 7 <= len(_digits(m[0])) <= 15]
        more += [(CARD, m.start(), m.end()) for m in _CARD.finditer(text) if 12 <= m.end() - m.start() and len(d := _digits(m[0])) in (12, 13) and luhn(d)]
    if not more:
        return []
    kept, i = [], 0
    taken = sorted((s, e) for _, s, e in base)
    for kind, s, e in sorted(more, key=lambda c: (c[1], c[0])):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if (i == len(taken) or taken[i][0] >= e) and (not kept or kept[-1][2] <= s):
            kept.append((kind, s, e))
    return kept


def votes(text: str, span: tuple[int, int, int], strict: bool, near: bool) -> tuple[int, ...]:
    """What the labelers say: 2 yes, 1 abstain, 0 no."""
    kind, s, e = span
    value = text[s:e]
    d = _digits(value)
    if kind == EMAIL:
        tld = re.split(r"[^A-Za-z0-9]+", value.rstrip(")]"))[-1].lower()
        known = 2 if tld in TLDS else 0
        check = 2 if len(value) <= 254 and ".." not in value else 0
    elif kind == IP:
        parts = [int(p) for p in value.split(".")]
        known = 0 if parts[0] in (0, 127) or parts[0] >= 224 else 2
        check = 0 if max(parts) < 10 or any(len(p) > 1 and p[0] == "0" for p in value.split(".")) else 2
    elif kind == CARD:
        known = 2 if d.startswith(CARD_PREFIXES) else 0
        check = 2 if luhn(d) else 0
    else:
        known = (2 if d.startswith(COUNTRY_CODES) else 0) if strict else (2 if len(d) == 10 and d[0] in "23456789" else 1)
        check = 2 if 10 <= len(d) <= 12 else 0
        if re.fullmatch(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}", value):
            check = 0
    around = {w.lower() for w in _WORD.findall(text[max(0, s - 48) : s])[-5:]}
    context = 0 if around & AGAINST else 2 if around & TRIGGERS[kind] else 1
    return (2 if strict else 0 if kind == PHONE and value.count(".") > 1 else 1, known, context, check, 2 if near else 1)


N_LABELERS = 5


def code(kind: int, v: tuple[int, ...], length: int) -> int:
    """A candidate's pattern as one integer: kind, votes, and its length in three classes."""
    out = kind
    for x in v:
        out = out * 3 + x
    return out * 3 + (length > 12) + (length > 20)


def decode(c: int) -> tuple[int, tuple[int, ...], int]:
    c, length = divmod(c, 3)
    v = []
    for _ in range(N_LABELERS):
        c, x = divmod(c, 3)
        v.append(x)
    return c, tuple(reversed(v)), length


def scan(text: str) -> tuple[list, list, list[int], list[int]]:
    """Base spans, wider candidates, and the pattern codes of either."""
    base = base_spans(text)
    wide = wide_spans(text, base)
    every = sorted(base + wide, key=lambda s: s[1])
    starts = [s[1] for s in every]

    def near(span) -> bool:
        i = bisect.bisect_left(starts, span[1] - 80)
        return any(o is not span and abs(o[1] - span[1]) <= 80 for o in every[i : i + 4])

    return base, wide, [code(s[0], votes(text, s, True, near(s)), s[2] - s[1]) for s in base], [code(s[0], votes(text, s, False, near(s)), s[2] - s[1]) for s in wide]


def reliabilities(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """EM over vote patterns, kind by kind: code -> posterior that the candidate is personal data."""
    out: dict[int, float] = {}
    for kind in range(len(KINDS)):
        rows = [(c, decode(c)[1], n) for c, n in sorted(counts.items()) if decode(c)[0] == kind]
        if not rows:
            continue
        v = np.array([r[1] for r in rows])
        n = np.array([r[2] for r in rows], dtype=float)
        p = 1 / (1 + np.exp(-(v - 1).sum(axis=1)))
        for _ in range(rounds):
            prior = np.clip((n @ p) / n.sum(), 0.01, 0.99)
            odds = np.full(len(rows), np.log(prior / (1 - prior)))
            for k in range(v.shape[1]):
                for x in (0, 2):  # an abstention says nothing
                    is_x, voted = v[:, k] == x, v[:, k] != 1
                    yes = (n[is_x] @ p[is_x] + 1 + (x == 2)) / (n[voted] @ p[voted] + 3)
                    no = (n[is_x] @ (1 - p[is_x]) + 1 + (x == 0)) / (n[voted] @ (1 - p[voted]) + 3)
                    odds[is_x] += np.log(yes / no)
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        out |= {r[0]: float(x) for r, x in zip(rows, p, strict=True)}
    return out


def _features(c: int) -> np.ndarray:
    kind, v, length = decode(c)
    x = np.zeros(len(KINDS) * (1 + 3 * N_LABELERS + 3))
    at = kind * (1 + 3 * N_LABELERS + 3)
    x[at] = 1
    for k, vote in enumerate(v):
        x[at + 1 + 3 * k + vote] = 1
    x[at + 1 + 3 * N_LABELERS + length] = 1
    return x


def train_classifier(counts: dict[int, int], steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights of the logistic span classifier, on EM's posteriors of all patterns."""
    if not counts:
        return np.zeros(len(_features(0)))
    soft = reliabilities(counts)
    x = np.array([_features(c) for c in soft])
    y = np.array(list(soft.values()))
    n = np.sqrt(np.array([counts[c] for c in soft], dtype=float))
    n /= n.sum()
    w, g2 = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(steps):
        g = x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) + decay * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2 + 1e-12)
    return w


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0])))


_SCANNED = "doc_id long, base array<int>, wide array<int>, base_codes array<int>, wide_codes array<int>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (kind, start, end, kind, ...) with their pattern codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            cols = [[], [], [], []]
            for text in batch.column(1):
                base, wide, bc, wc = scan(text.as_py() or "")
                for to, x in zip(cols, ([i for s in base for i in s], [i for s in wide for i in s], bc, wc), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c in cols)], ["doc_id", "base", "wide", "base_codes", "wide_codes"])

    small_batches(docs.sparkSession)
    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, _SCANNED)


def fit(scanned: DataFrame) -> np.ndarray:
    """The classifier's weights from the pattern counts of all candidates."""
    codes = scanned.select(F.explode(F.concat("base_codes", "wide_codes")).alias("code"))
    return train_classifier({r["code"]: r["count"] for r in codes.groupBy("code").count().collect()})


def accepted(wide: list[tuple[int, int, int]], codes: list[int], weights: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    return [s for s, c in zip(wide, codes, strict=True) if 1 / (1 + np.exp(-(_features(c) @ weights))) >= least]


def _triples(flat: list[int]) -> list[tuple[int, int, int]]:
    return list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))


def find_pii(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and all spans, of every row."""
    scanned = cut(candidates(docs), "pii")
    weights = fit(scanned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[] for _ in KINDS], [], []
            for base, wide, codes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                base, wide = _triples(base), _triples(wide)
                for k, to in enumerate(counts):
                    to.append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
                spans.append(_join(base + accepted(wide, codes, weights, least)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return scanned.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """`docs` with every span of its texts replaced by "[KIND]"; a null text stays null.

    Overlapping spans are replaced together, under the name of the first.
    """
    weights = fit(cut(candidates(docs).select("base_codes", "wide_codes"), "pii-codes"))
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        base, wide, _, codes = scan(text)
        out, end = [], 0
        for k, s, e in sorted(base + accepted(wide, codes, weights, least), key=lambda x: (x[1], x[0])):
            if s >= end:
                out += [text[end:s], f"[{KINDS[k].upper()}]"]
            end = max(end, e)
        return "".join(out) + text[end:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            cols[at] = pa.array([clean(t.as_py()) for t in cols[at]], pa.string())
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
