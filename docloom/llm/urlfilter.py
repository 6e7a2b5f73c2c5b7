"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And automaton: bit i of
rule r stands for "the first i characters of r are matched".  A step shifts
the state words, masks them with the words of the character read, and keeps
the states that hold a wildcard; every rule so advances at once.  Batches of
URLs are stepped together, a column of characters at a time.

Globs: `*` any run of characters, `~` any run without "/", `?` one character;
all else stands for itself.  A glob must match the whole canonical URL, which
is "." + host + path (no scheme, query or fragment; host in lower case).

Defined results: a null URL, or one without "://", has empty host and path and
fits no rule; very long URLs are matched whole; repeated rows are judged each
on its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import small_batches

#: (verdict, host and path prefix): fits the host and all its subdomains; the longest wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Globs for URLs that fit none of the rules; the first one that matches decides, else DEFAULT.
GLOBS = (("block", "~/*.exe"), ("block", "~/*.zip"), ("block", "~/ads/*"), ("block", "~/*/ads/*"))
DEFAULT = "allow"
#: Longer URLs are stepped one at a time on integers of any width.
LONG = 4096
SCHEMA = "page_id long, host string, path string, rule string, verdict string"

_UPPER = {c: c + 32 for c in range(65, 91)}
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    """Host in lower case and path; both empty without "://"."""
    m = _URL.search(url) if url is not None else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


class WildcardAutomaton:
    def __init__(self, globs: list[str]):
        starts, accepts, at = 0, [], 0
        literal: dict[str, int] = {}  # character -> states entered on it
        one, loops, host_loops = 0, 0, 0
        for glob in globs:
            starts |= 1 << at
            for ch in glob:
                if ch == "*":
                    loops |= 1 << at
                elif ch == "~":
                    host_loops |= 1 << at
                else:
                    at += 1
                    if ch == "?":
                        one |= 1 << at
                    else:
                        literal[ch] = literal.get(ch, 0) | 1 << at
            accepts.append(at)
            at += 1
        self.start, self.accepts, self.n_words = starts, accepts, at // 64 + 1
        self.alphabet = sorted(literal.keys() | {"/"})
        # Entry 0 stands for all characters that no rule names.
        self.enter = [one] + [literal.get(c, 0) | one for c in self.alphabet]
        self.stay = [loops | host_loops] + [loops | (0 if c == "/" else host_loops) for c in self.alphabet]
        self.index = {c: i + 1 for i, c in enumerate(self.alphabet)}

    def _words(self, values: list[int]) -> np.ndarray:
        mask = (1 << 64) - 1
        return np.array([[(v >> (64 * k)) & mask for k in range(self.n_words)] for v in values], dtype=np.uint64)

    def scan(self, text: str) -> int:
        d = self.start
        for ch in text:
            i = self.index.get(ch, 0)
            d = ((d << 1) & self.enter[i]) | (d & self.stay[i])
        return d

    def match(self, texts: list[str]) -> np.ndarray:
        """Boolean array (texts, globs)."""
        n = len(texts)
        state = np.repeat(self._words([self.start]), n, axis=0)
        short = [i for i, t in enumerate(texts) if len(t) <= LONG]
        if short:
            codes = np.frombuffer("".join(texts[i] for i in short).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            known = np.array([ord(c) for c in self.alphabet], dtype=np.uint32)
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            classes = np.where(known[at] == codes, at + 1, 0).astype(np.int32)
            sizes = np.array([len(texts[i]) for i in short])
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            order = np.argsort(-sizes, kind="stable")
            sizes, begins = sizes[order], begins[order]
            enter, stay = self._words(self.enter), self._words(self.stay)
            d = np.repeat(self._words([self.start]), len(short), axis=0)
            ends = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")
            for step, live in enumerate(ends):
                c = classes[begins[:live] + step]
                s = d[:live]
                moved = s << np.uint64(1)
                moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
                d[:live] = (moved & enter[c]) | (s & stay[c])
            state[np.array(short)[order]] = d
        for i, t in enumerate(texts):
            if len(t) > LONG:
                state[i] = self._words([self.scan(t)])[0]
        hit = [(state[:, a // 64] >> np.uint64(a % 64)) & np.uint64(1) for a in self.accepts]
        return np.stack(hit, axis=1).astype(bool) if hit else np.zeros((n, 0), dtype=bool)


def filter_urls(pages: DataFrame, rules=RULES, globs=GLOBS, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict of every row."""
    rules, globs = list(rules), list(globs)
    automaton = WildcardAutomaton(["~." + r for _, r in rules for r in [r + "*"]] + [g for _, g in globs])
    longest = sorted(range(len(rules)), key=lambda i: -len(rules[i][1]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(1).to_pylist()
            parts = [split_url(u) for u in urls]
            hits = automaton.match(["." + h + p for h, p in parts])
            rule, verdict = [], []
            for row in hits:
                fit = next((i for i in longest if row[i]), None)
                rule.append(None if fit is None else rules[fit][1])
                other = next((globs[k][0] for k in range(len(globs)) if row[len(rules) + k]), default)
                verdict.append(other if fit is None else rules[fit][0])
            cols = [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "host", "path", "rule", "verdict"])

    small_batches(pages.sparkSession, 2000)
    return pages.select(F.col("page_id").cast("long"), "url").mapInArrow(judge, SCHEMA)


ORACLE = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS p FROM pages),
a AS (SELECT page_id, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest FROM u),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, '.' || host AS h FROM b),
d AS (SELECT *, CASE WHEN ends_with(h, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                     WHEN ends_with(h, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                     WHEN ends_with(h, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
                     WHEN ends_with(h, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                     WHEN ends_with(h, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM c)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'www.example.com/en/' THEN 'allow' WHEN 'com/' THEN 'allow'
                 WHEN 'example.com/en/' THEN 'block' WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block'
                 ELSE CASE WHEN starts_with(path, '/') AND (ends_with(path, '.exe') OR ends_with(path, '.zip') OR starts_with(path, '/ads/') OR contains(path, '/ads/'))
                      THEN 'block' ELSE 'allow' END END AS verdict
FROM d
"""
