"""Parsers of textual formats: bytes in, a Document out.

Each raises ConversionError where the format's own rules are broken; what can
be kept is kept with a diagnostic.
"""

from __future__ import annotations

import base64
import csv
import hashlib
import io
import json
import re
import urllib.parse
import xml.parsers.expat
import zlib
from email.utils import parsedate_to_datetime

from docloom.plans import ir
from docloom.plans.ir import ConversionError, Document

BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
#: Tried in this order where a text is neither marked nor UTF-8.
LEGACY = ("gb18030", "big5", "shift_jis", "cp1252")


def decode(data: bytes, charset: str | None = None, strict: bool = True) -> str:
    """Text by its mark, as UTF-8, or by the charset given; a charset that contradicts the mark is an error."""
    for bom, name in BOMS:
        if data.startswith(bom):
            if charset and charset.lower().replace("_", "-").split("-")[0] != name.split("-")[0]:
                raise ConversionError("charsetConflict")
            data, charset = data[len(bom) :], name
            break
    try:
        return data.decode(charset or "utf-8", "strict" if strict else "replace")
    except (UnicodeDecodeError, LookupError):
        raise ConversionError("malformed") from None


def sniff_legacy(data: bytes) -> str | None:
    """The first legacy charset that gives clean text and back again."""
    for name in LEGACY:
        try:
            s = data.decode(name)
            if s.encode(name) == data and not re.search(r"[\x00-\x08\x0e-\x1f\x7f-\x9f]", s):
                return name
        except UnicodeError:
            continue
    return None


def text_document(data: bytes, **_) -> Document:
    s = decode(data)
    if re.search(r"\x00", s):
        raise ConversionError("malformed")
    doc, run = Document(), []
    for line in re.split(r"\r\n|\r|\n", s):
        if line:
            run.append(line)
        elif run:
            doc.blocks.append(ir.paragraph(*ir.lines("\n".join(run))))
            run = []
    if run:
        doc.blocks.append(ir.paragraph(*ir.lines("\n".join(run))))
    return doc


def _records(s: str, sep: str) -> list[list[str]]:
    """RFC 4180 records; a quote that is not closed, or closed amid a field, is malformed."""
    out, row, i, n = [], [], 0, len(s)
    end = re.compile(f"[{re.escape(sep)}\r\n]")
    while i < n:
        if s[i] == '"':
            part, i = [], i + 1
            while True:
                j = s.find('"', i)
                if j < 0:
                    raise ConversionError("malformed")
                part.append(s[i:j])
                i = j + 1
                if i < n and s[i] == '"':
                    part.append('"')
                    i += 1
                else:
                    break
            if i < n and s[i] not in (sep, "\r", "\n"):
                raise ConversionError("malformed")
            row.append("".join(part))
        else:
            m = end.search(s, i)
            j = m.start() if m else n
            if '"' in s[i:j]:
                raise ConversionError("malformed")
            row.append(s[i:j])
            i = j
        if i < n and s[i] == sep:
            i += 1
            if i == n:
                row.append("")
            continue
        if s.startswith("\r\n", i):
            i += 2
        elif i < n:
            i += 1
        out.append(row)
        row = []
    if row:
        out.append(row)
    return out


def is_number(s: str) -> bool:
    return bool(re.fullmatch(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf|infinity|nan)", s.strip(), re.I))


def has_header(rows: list[list[str]]) -> bool:
    """Names over numbers: no blank or repeated name, and a column that is numeric below its name."""
    if len(rows) < 2:
        return False
    names = [h.strip() for h in rows[0]]
    if any(not h for h in names) or len({h.lower() for h in names}) < len(names):
        return False
    for c, h in enumerate(names):
        below = [r[c].strip() for r in rows[1:] if c < len(r) and r[c].strip()]
        if not is_number(h) and below and all(map(is_number, below)):
            return True
    return False


def delimited_document(data: bytes, sep: str = ",", header: str = "auto", ragged: str = "strict", max_columns: int = 16_384, **_) -> Document:
    rows = _records(decode(data), sep)
    doc = Document()
    if not rows:
        return doc
    width = len(rows[0])
    if max(map(len, rows)) > max_columns:
        raise ConversionError("resourceLimit", limit="max_table_columns")
    for r in rows:
        if len(r) > width or (len(r) < width and ragged == "strict"):
            raise ConversionError("malformed")
        if len(r) < width:
            doc.diagnostics.append(("delimited.raggedRow", "warning", ""))
            r += [""] * (width - len(r))
    top = header == "always" or header == "auto" and has_header(rows)
    doc.blocks.append(ir.table([[ir.lines(c) for c in r] for r in rows], header=top))
    return doc


def _pairs(pairs: list[tuple]) -> list[tuple]:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ConversionError("malformed")
    return [("{", pairs)]


def _refuse(x: str):
    raise ConversionError("malformed")


def json_document(data: bytes, max_depth: int = 128, **_) -> Document:
    s = decode(data)
    depth = best = 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', s):
        depth += (m[0] in "[{") - (m[0] in "]}")
        best = max(best, depth)
    if best > max_depth:
        raise ConversionError("resourceLimit", limit="json_nesting_depth")
    try:
        value = json.loads(s, object_pairs_hook=_pairs, parse_constant=_refuse, parse_float=lambda x: ("#", x), parse_int=lambda x: ("#", x))
    except (ValueError, RecursionError):
        raise ConversionError("malformed") from None
    doc = Document(blocks=[ir.heading(1, ir.text("JSON"))])

    def scalar(v) -> str:
        return v[1] if isinstance(v, tuple) else json.dumps(v, ensure_ascii=False)

    def is_object(v) -> bool:
        return isinstance(v, list) and len(v) == 1 and isinstance(v[0], tuple) and v[0][0] == "{"

    def walk(v, depth: int) -> None:
        for label, x in v[0][1] if is_object(v) else [(f"[{i}]", x) for i, x in enumerate(v)]:
            if isinstance(x, list):
                doc.blocks.append(ir.heading(min(depth + 2, 6), ir.text(label)))
                walk(x, depth + 1)
            else:
                doc.blocks.append(ir.paragraph(ir.text(label, "code"), ir.text(": "), ir.text(scalar(x), "code")))

    if isinstance(value, list):
        walk(value, 1)
    else:
        doc.blocks.append(ir.code(scalar(value), "json"))
    return doc


def xml_document(data: bytes, max_depth: int = 128, **_) -> Document:
    doc, stack, run = Document(), [], []
    parser = xml.parsers.expat.ParserCreate()
    parser.buffer_text = True

    def flush() -> None:
        s = " ".join("".join(run).split())
        run.clear()
        if s:
            doc.blocks.append(ir.paragraph(ir.text(s)))

    def namespace(prefix: str) -> str:
        for scope in reversed(stack):
            if prefix in scope:
                return scope[prefix]
        if prefix and prefix != "xml":
            raise ConversionError("malformed")
        return "http://www.w3.org/XML/1998/namespace" if prefix == "xml" else ""

    def start(name: str, attrs: dict) -> None:
        flush()
        if len(stack) >= max_depth:
            raise ConversionError("resourceLimit", limit="xml_nesting_depth")
        stack.append({k.partition(":")[2]: v for k, v in attrs.items() if k == "xmlns" or k.startswith("xmlns:")})
        prefix, _, local = name.rpartition(":")
        title = f'{name} (local={local}, prefix="{prefix}", namespace="{namespace(prefix)}")'
        doc.blocks.append(ir.heading(min(len(stack), 6), ir.text(title)))
        for k, v in attrs.items():
            if k != "xmlns" and not k.startswith("xmlns:"):
                doc.blocks += [ir.code(k, "xml-attribute-name"), ir.code(v, "xml-attribute-value")]

    def end(_: str) -> None:
        flush()
        stack.pop()

    def doctype(*_) -> None:
        raise ConversionError("malformed")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, run.append
    parser.StartDoctypeDeclHandler = doctype
    parser.CommentHandler = lambda s: doc.properties.setdefault(f"xml.comment.{len(doc.properties)}", s)
    parser.ProcessingInstructionHandler = lambda t, s: (flush(), doc.blocks.append(ir.code(f"{t} {s}".strip(), "xml-processing-instruction")))
    try:
        parser.Parse(data, True)
    except xml.parsers.expat.ExpatError:
        raise ConversionError("malformed") from None
    return doc


def markdown_document(data: bytes, max_depth: int = 64, **_) -> Document:
    """Markdown is passed through as it is; its blocks are read for the node table."""
    s = decode(data)
    if "\x00" in s:
        raise ConversionError("malformed")
    doc = Document(properties={"verbatim": s})
    kind, run, fence = None, [], None

    def flush() -> None:
        nonlocal kind
        if run:
            body = "\n".join(run)
            if kind == "code":
                doc.blocks.append(ir.code(body, fence))
            elif kind == "list":
                doc.blocks.append(ir.bullet_list([[ir.paragraph(ir.text(re.sub(r"^\s*(?:[-*+]|\d+[.)])\s+", "", x)))] for x in run]))
            elif kind == "table":
                cells = [[[ir.text(c.strip())] for c in x.strip().strip("|").split("|")] for x in run if not re.fullmatch(r"[\s|:-]+", x)]
                doc.blocks.append(ir.table(cells, header=True))
            elif kind == "quote":
                if max(len(re.match(r"[> ]*", x)[0].replace(" ", "")) for x in run) > max_depth:
                    raise ConversionError("resourceLimit", limit="max_nesting_depth")
                doc.blocks.append(ir.code(body, "markdown"))
            else:
                doc.blocks.append(ir.paragraph(*ir.lines(body)))
            run.clear()
        kind = None

    open_fence = None
    for line in re.split(r"\r\n|\r|\n", s):
        m = re.match(r" {0,3}(`{3,}|~{3,})\s*(\S*)", line)
        if open_fence:
            if m and m[1][0] == open_fence[0] and len(m[1]) >= len(open_fence) and not m[2]:
                kind = "code"
                run[:] = run or [""]
                flush()
                open_fence = None
            else:
                run.append(line)
            continue
        if m:
            flush()
            open_fence, fence = m[1], m[2] or None
            continue
        if h := re.match(r" {0,3}(#{1,6})\s+(.*?)\s*#*$", line):
            flush()
            doc.blocks.append(ir.heading(len(h[1]), ir.text(h[2])))
            continue
        now = None if not line.strip() else "list" if re.match(r"\s*(?:[-*+]|\d+[.)])\s", line) else "table" if line.lstrip().startswith("|") else "quote" if line.lstrip().startswith(">") else "text"
        if now != kind:
            flush()
            kind = now
        if now:
            run.append(line)
    if open_fence:
        kind = "code"
    flush()
    return doc


_ANSI = re.compile(r"\x1b\[[0-?]*[ -/]*[@-~]|\x1b\][^\x07]*(?:\x07|\x1b\\)|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_MIME_ORDER = ("image/png", "image/jpeg", "image/gif", "image/webp", "text/markdown", "text/plain", "text/html")


def notebook_document(data: bytes, **_) -> Document:
    try:
        book = json.loads(decode(data))
    except ValueError:
        raise ConversionError("malformed") from None
    if not isinstance(book, dict) or book.get("nbformat") != 4 or not isinstance(book.get("cells"), list):
        raise ConversionError("malformed")
    language = (book.get("metadata", {}).get("language_info") or {}).get("name") or (book.get("metadata", {}).get("kernelspec") or {}).get("language")
    join = lambda s: "".join(s) if isinstance(s, list) else s or ""
    doc = Document()
    for cell in book["cells"]:
        kind, source = cell.get("cell_type"), join(cell.get("source"))
        if kind == "markdown":
            doc.blocks += markdown_document(source.encode()).blocks
        elif kind == "raw":
            doc.blocks.append(ir.code(source))
        elif kind == "code":
            number = cell.get("execution_count")
            doc.blocks += [ir.heading(3, ir.text(f"Code cell [{number if number is not None else ' '}]")), ir.code(source, language)]
            for o in cell.get("outputs", []):
                if o.get("output_type") == "stream":
                    doc.blocks.append(ir.code(_ANSI.sub("", join(o.get("text"))), "text"))
                elif o.get("output_type") == "error":
                    doc.blocks.append(ir.code(_ANSI.sub("", "\n".join(o.get("traceback", []))), "text"))
                else:
                    found = o.get("data", {})
                    mime = next((m for m in _MIME_ORDER if m in found), None)
                    if mime and mime.startswith("image/"):
                        doc.blocks.append(asset(doc, base64.b64decode(join(found[mime])), mime, "output"))
                    elif mime == "text/markdown":
                        doc.blocks += markdown_document(join(found[mime]).encode()).blocks
                    elif mime:
                        doc.blocks.append(ir.code(_ANSI.sub("", join(found[mime])), "html" if mime == "text/html" else "text"))
        else:
            raise ConversionError("malformed")
    return doc


EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg", "image/bmp": "bmp", "image/tiff": "tiff"}


def asset(doc: Document, data: bytes, mime: str, alt: str = "") -> dict:
    """Adds an asset, named by its content, and gives the block that shows it."""
    digest = hashlib.sha256(data).hexdigest()
    name = f"asset-{digest}.{EXTENSIONS.get(mime, 'bin')}"
    doc.assets.append({"filename": name, "media_type": mime, "sha256": digest, "size": len(data), "content": data})
    return {"kind": "image", "uri": f"assets/{name}", "alt": alt}


def _when(s: str) -> str:
    s = s.strip()
    try:
        return parsedate_to_datetime(s).isoformat()
    except (ValueError, TypeError):
        return s


def feed_document(data: bytes, base: str | None = None, **_) -> Document:
    """RSS 2.0 and Atom 1.0; an entry that repeats an id, a link or all its content is left out."""
    from docloom.sources.html import html_blocks

    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ConversionError("malformed")
    import xml.etree.ElementTree as ET

    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        raise ConversionError("malformed") from None
    local = lambda e: e.tag.rpartition("}")[2]
    atom = local(root) == "feed"
    top = root if atom else root.find("channel")
    if top is None:
        raise ConversionError("malformed")
    first = lambda e, *names: next((c for n in names for c in e if local(c) == n), None)
    said = lambda e: " ".join("".join(e.itertext()).split()) if e is not None else ""
    doc = Document(title=said(first(top, "title")) or None)
    seen = set()
    for e in (c for c in top if local(c) == ("entry" if atom else "item")):
        title, author = said(first(e, "title")), said(first(e, "author", "creator"))
        link = first(e, "link")
        if atom:
            ranks = {"text/html": 0, None: 1}
            links = [c for c in e if local(c) == "link" and c.get("rel", "alternate") == "alternate"]
            link = min(links, key=lambda c: ranks.get(c.get("type"), 2 if (c.get("type") or "").startswith("text") else 3), default=None)
        target = (link.get("href") if atom else said(link)) if link is not None else ""
        target = urllib.parse.urljoin(base or "", target) if target else ""
        guid = said(first(e, "id", "guid"))
        published, updated = (_when(said(first(e, *n))) for n in (("published", "pubDate", "date"), ("updated",)))
        bodies = [("Summary", first(e, "summary", "description")), ("Content", first(e, "content", "encoded"))]
        raw = ["" if b is None else "".join(b.itertext()) if not len(b) else ET.tostring(b, encoding="unicode") for _, b in bodies]
        parts = [title, author, published, updated, *raw]
        key = f"id:{guid}" if guid else f"link:{target}" if target else "digest:" + hashlib.sha256(b"".join(len(p.encode()).to_bytes(8, "big") + p.encode() for p in parts)).hexdigest()
        if key in seen:
            doc.diagnostics.append(("feed.duplicateEntry", "warning", key))
            continue
        seen.add(key)
        if title:
            doc.blocks.append(ir.heading(2, ir.text(title, link=target or None)))
        for label, value in (("Author", author), ("Published", published), ("Updated", updated)):
            if value:
                doc.blocks.append(ir.paragraph(ir.text(f"{label}: {value}")))
        for (label, b), s in zip(bodies, raw, strict=True):
            if b is not None and s.strip():
                doc.blocks.append(ir.heading(3, ir.text(label)))
                doc.blocks += html_blocks(s)
    return doc


def mediawiki_document(data: bytes, base: str | None = None, **_) -> Document:
    """The JSON of a wiki's action=parse."""
    from docloom.sources.html import html_blocks

    try:
        page = json.loads(decode(data))["parse"]
        body = page["text"] if isinstance(page["text"], str) else page["text"]["*"]
    except (ValueError, KeyError, TypeError):
        raise ConversionError("malformed") from None
    return Document(blocks=html_blocks(body, base), title=page.get("title"), properties={k: str(page[k]) for k in ("pageid", "revid") if k in page})


def drawio_document(data: bytes, **_) -> Document:
    """Pages in order: a list of the shapes by their parents, and a table of the connections."""
    import xml.etree.ElementTree as ET

    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ConversionError("malformed")
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        raise ConversionError("malformed") from None
    doc = Document()
    for number, page in enumerate(root.iter("diagram") if root.tag == "mxfile" else [root], 1):
        model = page if page.tag == "mxGraphModel" else page.find("mxGraphModel")
        if model is None and (page.text or "").strip():
            try:
                packed = zlib.decompress(base64.b64decode(page.text.strip()), -15)
                model = ET.fromstring(urllib.parse.unquote(packed.decode()))
            except (ValueError, zlib.error, ET.ParseError):
                raise ConversionError("malformed") from None
        if model is None:
            continue
        doc.blocks.append(ir.heading(2, ir.text(page.get("name") or f"Page {number}")))
        cells = {}
        for e in model.iter():
            if e.tag in ("mxCell", "object", "UserObject"):
                inner = e.find("mxCell") if e.tag != "mxCell" else e
                key = e.get("id") or (inner.get("id") if inner is not None else None)
                if inner is not None and key and key not in cells:
                    label = " ".join(re.sub(r"<[^>]+>", " ", e.get("label") or e.get("value") or inner.get("value") or "").split())
                    cells[key] = (label, inner)
        children: dict[str | None, list[str]] = {}
        for k, (_, c) in cells.items():
            if c.get("vertex") == "1":
                children.setdefault(c.get("parent"), []).append(k)
        seen: set[str] = set()

        def items(keys: list[str], depth: int = 0, cells=cells, children=children, seen=seen) -> list[list[dict]]:
            out = []
            for k in keys:
                if k not in seen and depth < 16:
                    seen.add(k)
                    below = items(children.get(k, []), depth + 1)
                    out.append([ir.paragraph(ir.text(cells[k][0] or k))] + ([ir.bullet_list(below)] if below else []))
            return out

        roots = [k for k, (_, c) in cells.items() if c.get("vertex") == "1" and cells.get(c.get("parent"), ("", None))[1] is not None and cells[c.get("parent")][1].get("vertex") != "1"]
        if shown := items(roots):
            doc.blocks.append(ir.bullet_list(shown))
        name = lambda k, cells=cells: cells[k][0] or k if k in cells else k or ""
        edges = [[[ir.text(name(c.get("source")))], [ir.text(name(c.get("target")))], [ir.text(label)]] for label, c in cells.values() if c.get("edge") == "1"]
        if edges:
            doc.blocks.append(ir.table([[[ir.text("Source")], [ir.text("Target")], [ir.text("Label")]], *edges], header=True))
    return doc


_RTF = re.compile(rb"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
_SKIP = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr generator themedata listtable listoverridetable datastore xmlnstbl fldinst".split())
_CODE_PAGES = {437: "cp437", 850: "cp850", 874: "cp874", 932: "shift_jis", 936: "gb18030", 949: "cp949", 950: "big5", 65001: "utf-8"}


def rtf_document(data: bytes, **_) -> Document:
    if not data.startswith(b"{\\rtf"):
        raise ConversionError("malformed")
    doc, run, stack = Document(), [], []
    state = {"marks": ir.NONE, "skip": False, "uc": 1}
    codec, owed, raw, cells, rows = "cp1252", 0, bytearray(), None, []

    def put(s: str) -> None:
        if s and not state["skip"]:
            run.append((s, state["marks"], None))

    def flush_raw() -> None:
        if raw:
            put(raw.decode(codec, "replace"))
            raw.clear()

    def end_paragraph() -> None:
        flush_raw()
        nonlocal rows
        if run and cells is None:
            if rows:
                doc.blocks.append(ir.table(rows))
                rows = []
            doc.blocks.append(ir.paragraph(*run))
            run.clear()

    symbols = {"par": None, "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}
    for m in _RTF.finditer(data):
        word, number, hexa, symbol, brace, plain = m.groups()
        if brace == b"{":
            flush_raw()
            stack.append(dict(state))
        elif brace == b"}":
            flush_raw()
            if not stack:
                raise ConversionError("malformed")
            state = stack.pop()
        elif word:
            flush_raw()
            w, n = word.decode(), int(number) if number else None
            if w in _SKIP:
                state["skip"] = True
            elif w in ("b", "i", "ul", "strike"):
                mark = {"b": "strong", "i": "emphasis", "ul": "underline", "strike": "strike"}[w]
                state["marks"] = state["marks"] - {mark} if n == 0 else state["marks"] | {mark}
            elif w in ("plain", "pard"):
                state["marks"] = ir.NONE if w == "plain" else state["marks"]
            elif w == "ansicpg" and n:
                codec = _CODE_PAGES.get(n, f"cp{n}")
            elif w == "uc":
                state["uc"] = n if n is not None else 1
            elif w == "u" and n is not None:
                put(chr(n % 65536) if not 0xD800 <= n % 65536 < 0xE000 else "\ufffd")
                owed = state["uc"]
            elif w == "par":
                end_paragraph()
            elif w == "line":
                run.append(ir.BREAK)
            elif w == "trowd":
                end_paragraph()
                cells = []
            elif w == "cell" and cells is not None:
                cells.append(list(run))
                run.clear()
            elif w == "row" and cells is not None:
                rows.append(cells)
                cells = None
            elif symbols.get(w):
                put(symbols[w])
        elif hexa:
            if owed:
                owed -= 1
            else:
                raw.append(int(hexa, 16))
        elif symbol:
            if symbol == b"*":
                state["skip"] = True
            elif symbol in (b"\\", b"{", b"}"):
                put(symbol.decode())
            elif symbol == b"~":
                put("\u00a0")
        elif plain:
            if owed:
                drop = min(owed, len(plain))
                plain, owed = plain[drop:], owed - drop
            raw += plain
    end_paragraph()
    if rows:
        doc.blocks.append(ir.table(rows))
    if stack:
        raise ConversionError("malformed")
    for b in doc.blocks:
        if b["kind"] == "paragraph" and b["inlines"]:
            t, k, link = b["inlines"][0]
            b["inlines"][0] = (t.lstrip(" "), k, link)
    return doc


def csv_rows(data: bytes) -> list[list[str]]:
    """Rows by the standard library, for comparison in tests."""
    return list(csv.reader(io.StringIO(decode(data))))
