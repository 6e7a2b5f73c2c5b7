"""Main text of web pages by equivalence-class template deduction.

Every page is parsed once into block tags with their paths and blocks of text.
For each host, tokens (a tag with its path, ids and classes included) get an
occurrence vector over the host's pages, kept as a fingerprint: the number of
pages and of occurrences, and the exclusive or of a hash of page and count,
which add up in any order and so need no page gathered with another.
Tokens of equal fingerprint form an equivalence class.  A class is valid if
it is on at least half of the host's pages, once a page, with two members or
more; the valid classes' paths nest into the host's template.  What lies
below a template tag and is no template tag itself is a slot; each slot's text
and link text are summed over the host, and the slot that holds most text
beyond its links is where the host keeps its articles.  Its enclosing
<article> or <main>, if there is one, is taken whole.

Never content are only elements and roles that mean something else (navigation,
footers, asides, forms, dialogs, hidden parts, headers outside an article), and
elements one of whose ids or classes says so with every one of its words
("ad", "cookie-notice", "comments"; not "share-price" or "comment-body").
Outside <article> and <main>, a class or id that says so with some of its
words only (`_weak`) is a last vote: such text counts a quarter when slots are
weighed, and is left out of a page whose host has no slot for it.

A page that lacks the host's container gives the blocks of its own <article>
or <main>, else all blocks that are not excluded or voted out.  Nothing within
the container is dropped for being repeated on other pages.

Host groups are only ever aggregates by path and a join on the host that can be
split, so one host may hold any share of the pages.  Markup may nest to any
depth: paths beyond `DEPTH` levels end in a hash of the deeper ones.

Defined results: null and empty html give an empty text; a null url counts as
the host ""; markup that is cut off is read to its end; repeated rows keep a
row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.urlfilter import split_url
from docloom.session import cut, small_batches, spread

#: Elements without content of their own, elements that hold no markup, and elements that stand on lines of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset("html body head address article aside blockquote caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Never content: elements, roles, and words that a class or id is made of.
NOT_CONTENT = frozenset("head title script style noscript template nav footer aside form button select option textarea input iframe object embed canvas svg dialog menu datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary dialog search alert menu menubar toolbar form".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup related respond share sharing sidebar social subscribe subscription toolbar widget".split())
CONTAINERS = ("article", "main")
#: Start tags that end an open element of these names.
_ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS |= {t: ("p",) for t in BLOCKS if t not in _ENDS and t not in ("html", "body", "head")}
_SCOPE = frozenset("html body table td th article main section div nav footer aside header ul ol dl".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_QUOTE = re.compile("[\"'>]")
#: Levels of a path that are written out.
DEPTH = 64


def _tag_end(s: str, at: int) -> int:
    """Where the tag that begins at `at` ends; quoted ">" does not end it."""
    i = at
    while m := _QUOTE.search(s, i):
        if m[0] == ">":
            return m.start()
        close = s.find(m[0], m.end())
        if close < 0:  # an open quote: the next ">" ends the tag
            return s.find(">", m.end())
        i = close + 1
    return -1


def says_no(label: str) -> tuple[bool, bool]:
    """Whether all, and whether some, words of an id or class are of what is never content."""
    words = [w.lower() for w in _WORD.findall(label)]
    known = [w in WORDS for w in words]
    return bool(words) and all(known), any(known)


def below(path: str, label: str, level: int) -> str:
    if level <= DEPTH:
        return f"{path}/{label}"
    head, _, deep = path.partition("/~")
    return f"{head}/~{crc32(f'{deep}/{label}'.encode()):08x}"


def parse(s: str) -> tuple[dict[str, int], list[tuple[str, str, str, int, bool]]]:
    """Block tags (path -> occurrences), and blocks of text that are not excluded: (path, container, text, link characters, weak)."""
    tags: dict[str, int] = {}
    blocks: list[tuple[str, str, str, int, bool]] = []
    stack: list[tuple[str, str, bool, bool, str, bool]] = [("", "", False, False, "", False)]  # name, path, excluded, link, container, weak
    run: list[str] = []
    links = 0

    def flush(path: str) -> None:
        nonlocal links
        if run:
            text = " ".join("".join(run).split())
            if text:
                blocks.append((path, stack[-1][4], text, links, stack[-1][5]))
            run.clear()
        links = 0

    def block_path() -> str:
        return stack[-1][1]

    def say(text: str) -> None:
        nonlocal links
        if stack[-1][2]:
            return
        text = _html.unescape(text)
        run.append(text)
        if stack[-1][3]:
            links += len(text)

    at, n = 0, len(s)
    while at < n:
        lt = s.find("<", at)
        if lt < 0:
            say(s[at:])
            break
        if lt > at:
            say(s[at:lt])
        nxt = s[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if s.startswith("<!--", lt):
                end = s.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = s.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = nxt == "/"
        m = _NAME.match(s, lt + 1 + closing)
        if not m:
            say("<")
            at = lt + 1
            continue
        end = _tag_end(s, m.end())
        if end < 0:
            break  # a tag that is cut off
        name, at = m[0].lower(), end + 1
        is_block = name in BLOCKS
        if name == "br":
            run.append(" ")
            continue
        if is_block:
            flush(block_path())
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if not is_block and any(e[0] in BLOCKS for e in stack[k + 1 :]):
                        break  # an inline end tag does not close blocks
                    del stack[k:]
                    break
            continue
        if name in _ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _ENDS[name]:
                    del stack[k:]
                    break
                if stack[k][0] in _SCOPE:
                    break
        raw = s[m.end() : end]
        label, bad = name, name in NOT_CONTENT
        _, path, excluded, link, container, weak = stack[-1]
        if raw.strip(" /\n\t\r"):
            attrs = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(raw)}
            names = [*attrs.get("id", "").split(), *attrs.get("class", "").split()]
            said = [says_no(x) for x in names] if name not in ("html", "body", "main") else []
            if name == "article" or container and name == "header":  # an article that is a comment; not the article's own header
                said = [(all_ and "comment" in x.lower(), False) for x, (all_, _) in zip(names, said, strict=True)]
            bad = bad or any(x for x, _ in said)
            weak = weak or not container and any(x for _, x in said)
            bad = bad or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
            words = [w.lower() for x in names for w in _WORD.findall(x)]
            if words and is_block:
                label += "." + ".".join(words)
        if name == "header" and not container:
            bad = True
        if is_block:
            path = below(path, label, len(stack))
            tags[path] = tags.get(path, 0) + 1
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(s, at)
            body_end = close.start() if close else n
            if not (excluded or bad):
                say(s[at:body_end])
            stop = s.find(">", body_end) if close else -1
            at = stop + 1 if stop >= 0 else n
            continue
        stack.append((name, path, excluded or bad, link or name == "a", container or (path if name in CONTAINERS else ""), weak))
    flush(block_path())
    return tags, blocks


_PARSED = "page_id long, url string, host string, blocks array<struct<path:string,container:string,text:string,links:int,weak:boolean>>, tags array<struct<path:string,n:int>>"


def parse_pages(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("path", "container", "text", "links", "weak")
        block = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_()), strict=True))))
        tag = pa.list_(pa.struct([("path", pa.string()), ("n", pa.int32())]))
        for batch in batches:
            hosts, blocks, tags = [], [], []
            for url, source in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                t, b = parse(source.as_py() or "")
                hosts.append(split_url(url)[0])
                blocks.append([dict(zip(names, x, strict=True)) for x in b])
                tags.append([{"path": p, "n": k} for p, k in t.items()])
            cols = [batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(blocks, block), pa.array(tags, tag)]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "host", "blocks", "tags"])

    small_batches(pages.sparkSession, 256)
    return spread(pages.select(F.col("page_id").cast("long"), "url", "html")).mapInArrow(run, _PARSED)


def templates(parsed: DataFrame, least: float = 0.5) -> DataFrame:
    """(host, path) of all tags of valid equivalence classes."""
    page = F.xxhash64("page_id", "url")
    tokens = parsed.select("host", page.alias("page"), F.explode("tags").alias("t")).groupBy("host", F.col("t.path").alias("path"))
    tokens = tokens.agg(F.count("*").alias("pages"), F.sum("t.n").alias("total"), F.bit_xor(F.xxhash64("page", "t.n")).alias("which"))
    # A host's pages: every page has the token "", as often as it is counted here.
    hosts = parsed.groupBy("host").agg(F.count("*").alias("all_pages"))
    vector = ["host", "pages", "total", "which"]
    classes = tokens.groupBy(*vector).agg(F.count("*").alias("members"))
    valid = classes.join(hosts, "host").where((F.col("members") >= 2) & (F.col("total") == F.col("pages")) & (F.col("pages") >= F.col("all_pages") * least))
    return tokens.join(valid.select(*vector), vector).select("host", "path")


def main_slots(parsed: DataFrame, template: DataFrame) -> DataFrame:
    """(host, main): the container of the slot that holds most text beyond its links."""
    slots = parsed.select("host", F.explode("blocks").alias("b")).groupBy("host", F.col("b.path").alias("path"), F.col("b.container").alias("container"))
    text = F.length("b.text") - 2 * F.col("b.links")
    slots = slots.agg(F.sum(F.when(F.col("b.weak"), text / 4).otherwise(text)).alias("text"))
    parts = F.filter(F.split("path", "/"), lambda p: ~F.startswith(p, F.lit("~")))
    steps = slots.select("host", "path", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("above"))
    t = template.select(F.col("host").alias("h"), F.col("path").alias("p"))
    under = steps.join(t, (F.col("host") == F.col("h")) & (F.col("above") == F.col("p"))).groupBy("host", "path").agg(F.max_by("above", F.length("above")).alias("tag"))
    under = under.select(F.col("host").alias("uh"), F.col("path").alias("up"), "tag")
    placed = slots.join(under, (F.col("host") == F.col("uh")) & (F.col("path") == F.col("up")), "left")
    where = F.when(F.col("container") != "", F.col("container")).otherwise(F.coalesce("tag", F.lit("")))
    sums = placed.groupBy("host", where.alias("main")).agg(F.sum("text").alias("text"))
    return sums.groupBy("host").agg(F.max_by("main", F.struct("text", "main")).alias("main"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`."""
    parsed = cut(parse_pages(pages), "html-parsed")
    # Written, its size is known: Spark broadcasts it if it is small, and else shuffles both sides.
    main = cut(main_slots(parsed, templates(parsed)).select(F.col("host").alias("h"), "main"), "html-main")
    x = parsed.select("page_id", "url", "host", "blocks").join(main, F.col("host") == F.col("h"), "left")
    here = F.coalesce("main", F.lit(""))
    inside = F.filter("blocks", lambda b: (here != "") & ((b["path"] == here) | (b["container"] == here) | F.startswith(b["path"], F.concat(here, F.lit("/")))))
    own = F.filter("blocks", lambda b: b["container"] != "")
    x = x.select("page_id", "url", "blocks", inside.alias("inside"), own.alias("own"))
    kept = F.when(F.size("inside") > 0, F.col("inside")).when(F.size("own") > 0, F.col("own")).otherwise(F.filter("blocks", lambda b: ~b["weak"]))
    x = x.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), " ").alias("text"))
    return x.withColumn("n_chars", F.char_length("text").cast("long"))
