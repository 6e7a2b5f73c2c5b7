"""Parsers of packaged formats: office documents, books and archives.

Only the members that are needed are inflated, and never beyond `MAX_MEMBER`.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import urllib.parse
import xml.etree.ElementTree as ET
import zipfile
from datetime import datetime, timedelta

from docloom.plans import ir
from docloom.plans.ir import ConversionError, Document
from docloom.sources.html import html_blocks
from docloom.sources.text_formats import asset

MAX_MEMBERS = 4096
MAX_MEMBER = 64 << 20
_IMAGES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml"}


def _children(e):
    """The children of an element that may be missing."""
    return () if e is None else e


def local(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def attr(e, name: str, default: str | None = None) -> str | None:
    """An attribute by its local name."""
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), default)


def child(e, *names: str):
    for n in names:
        e = next((c for c in e if local(c) == n), None) if e is not None else None
    return e


class Package:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, NotImplementedError):
            raise ConversionError("malformed") from None
        infos = self.zip.infolist()
        if len(infos) > MAX_MEMBERS:
            raise ConversionError("resourceLimit", limit="max_archive_entries")
        if any(i.flag_bits & 1 for i in infos):
            raise ConversionError("encrypted")
        self.names = {i.filename: i for i in infos}

    def read(self, name: str) -> bytes | None:
        info = self.names.get(name.lstrip("/"))
        if info is None:
            return None
        if info.file_size > MAX_MEMBER:
            raise ConversionError("resourceLimit", limit="max_archive_member_bytes")
        try:
            return self.zip.read(info)
        except (zipfile.BadZipFile, OSError, NotImplementedError, struct.error):
            raise ConversionError("malformed") from None

    def xml(self, name: str):
        data = self.read(name)
        if data is None:
            return None
        if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
            raise ConversionError("malformed")
        try:
            return ET.fromstring(data)
        except ET.ParseError:
            raise ConversionError("malformed") from None

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """Relation id -> (target, type, external)."""
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels".lstrip("/"))
        out = {}
        for r in root if root is not None else ():
            external = r.get("TargetMode") == "External"
            target = r.get("Target", "")
            if not external:
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            if r.get("Id") in out:
                raise ConversionError("malformed")
            out[r.get("Id")] = (target, r.get("Type", "").rpartition("/")[2], external)
        return out


def _properties(pkg: Package, doc: Document) -> None:
    core = pkg.xml("docProps/core.xml")
    for e in core if core is not None else ():
        if e.text and local(e) == "title":
            doc.title = e.text
        elif e.text and local(e) == "creator":
            doc.authors.append(e.text)


# -- word processing ---------------------------------------------------------


def docx_document(data: bytes, **_) -> Document:
    pkg = Package(data)
    main = next((t for t, k, _ in pkg.relations("").values() if k == "officeDocument"), "word/document.xml")
    root = pkg.xml(main)
    if root is None or child(root, "body") is None:
        raise ConversionError("malformed")
    folder, rels, doc = posixpath.dirname(main), pkg.relations(main), Document()
    _properties(pkg, doc)
    styles = {}
    for s in _children(pkg.xml(f"{folder}/styles.xml")):
        if local(s) == "style":
            level = child(s, "pPr", "outlineLvl")
            name = (attr(child(s, "name"), "val", "") if child(s, "name") is not None else "").lower()
            m = re.fullmatch(r"heading ([1-9])", name)
            styles[attr(s, "styleId")] = 1 if name == "title" else int(m[1]) if m else int(attr(level, "val", "9")) + 1 if level is not None else None
    formats, numbers = {}, {}
    for n in _children(pkg.xml(f"{folder}/numbering.xml")):
        if local(n) == "abstractNum":
            formats[attr(n, "abstractNumId")] = {attr(x, "ilvl"): attr(child(x, "numFmt"), "val", "bullet") if child(x, "numFmt") is not None else "bullet" for x in n if local(x) == "lvl"}
        elif local(n) == "num":
            numbers[attr(n, "numId")] = attr(child(n, "abstractNumId"), "val")
    notes: dict[str, list[dict]] = {}

    def runs(p, link: str | None = None) -> list[ir.Run]:
        out: list[ir.Run] = []
        for e in p:
            kind = local(e)
            if kind == "hyperlink":
                target = rels.get(attr(e, "id"), ("", "", False))
                anchor = attr(e, "anchor")
                out += runs(e, target[0] if target[2] else f"#{anchor}" if anchor else None)
            elif kind in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple"):
                out += runs(e, link)
            elif kind == "oMath" or kind == "oMathPara":
                out.append(ir.text("".join(t.text or "" for t in e.iter() if local(t) == "t"), "formula"))
            elif kind == "r":
                marks = set()
                for f in child(e, "rPr") if child(e, "rPr") is not None else ():
                    on = attr(f, "val", "true") not in ("0", "false", "none", "off")
                    name = {"b": "strong", "i": "emphasis", "strike": "strike", "u": "underline"}.get(local(f))
                    if name and on:
                        marks.add(name)
                    if local(f) == "vertAlign":
                        marks |= {"superscript": {"sup"}, "subscript": {"sub"}}.get(attr(f, "val"), set())
                for x in e:
                    if local(x) == "t":
                        out.append((x.text or "", frozenset(marks), link))
                    elif local(x) in ("br", "cr"):
                        out.append(ir.BREAK)
                    elif local(x) == "tab":
                        out.append(("\t", frozenset(marks), link))
                    elif local(x) in ("footnoteReference", "endnoteReference"):
                        out.append((f"[^{local(x)[:-9]}-{attr(x, 'id')}]", frozenset({"raw"}), None))
                    elif local(x) in ("drawing", "pict"):
                        for blip in x.iter():
                            rel = rels.get(attr(blip, "embed") or (attr(blip, "id") if local(blip) == "imagedata" else None) or "")
                            if rel and not rel[2] and (content := pkg.read(rel[0])):
                                mime = _IMAGES.get(rel[0].rpartition(".")[2].lower(), "application/octet-stream")
                                pending.append(asset(doc, content, mime))
        return out

    pending: list[dict] = []

    def body(parent) -> list[dict]:
        out: list[dict] = []
        open_list: list[tuple] = []

        def close() -> None:
            if open_list:
                out.append(_nest(open_list))
                open_list.clear()

        for e in parent:
            if local(e) == "p":
                props = child(e, "pPr")
                style = styles.get(attr(child(props, "pStyle"), "val")) if props is not None and child(props, "pStyle") is not None else None
                number = child(props, "numPr") if props is not None else None
                inlines = [r for r in runs(e) if r[0]]
                if number is not None and not style and inlines:
                    n, depth = (attr(child(number, k), "val", "0") if child(number, k) is not None else "0" for k in ("numId", "ilvl"))
                    ordered = formats.get(numbers.get(n), {}).get(depth, "bullet") not in ("bullet", "none")
                    open_list.append((int(depth), ordered, [ir.paragraph(*inlines)]))
                else:
                    close()
                    if inlines:
                        out.append(ir.heading(style, *inlines) if style and style <= 6 else ir.paragraph(*inlines))
                out += pending
                pending.clear()
            elif local(e) == "tbl":
                close()
                out.append(_word_table(e, runs))
            elif local(e) in ("sdt", "sdtContent", "ins", "customXml"):
                close()
                out += body(e)
            elif local(e) == "altChunk":
                close()
                rel = rels.get(attr(e, "id") or "")
                if rel and (content := pkg.read(rel[0])) and rel[0].endswith((".htm", ".html", ".xhtml")):
                    out += html_blocks(content.decode("utf-8", "replace"))
        close()
        return out

    doc.blocks = body(child(root, "body"))
    for kind in ("footnote", "endnote"):
        for n in pkg.xml(f"{folder}/{kind}s.xml") or ():
            if local(n) == kind and attr(n, "type") is None:
                notes[f"{kind}-{attr(n, 'id')}"] = body(n)
    doc.blocks += [{"kind": "footnote", "label": k, "blocks": b} for k, b in notes.items() if b]
    return doc


def _nest(items: list[tuple]) -> dict:
    """A list from (depth, ordered, blocks) in order."""
    depth, ordered = items[0][0], items[0][1]
    out: list[list[dict]] = []
    i = 0
    while i < len(items):
        if items[i][0] <= depth or not out:
            out.append(list(items[i][2]))
            i += 1
        else:
            j = i
            while j < len(items) and items[j][0] > depth:
                j += 1
            out[-1].append(_nest(items[i:j]))
            i = j
    return ir.bullet_list(out, ordered)


def _word_table(e, runs) -> dict:
    rows, above = [], {}
    for tr in (x for x in e if local(x) == "tr"):
        row, at = [], 0
        for tc in (x for x in tr if local(x) == "tc"):
            props = child(tc, "tcPr")
            span = int(attr(child(props, "gridSpan"), "val", "1")) if props is not None and child(props, "gridSpan") is not None else 1
            merge = child(props, "vMerge") if props is not None else None
            cell: list[ir.Run] = []
            for p in (x for x in tc if local(x) == "p"):
                got = runs(p)
                cell += [ir.BREAK] * (2 * bool(cell and got)) + got
            if merge is not None and attr(merge, "val") != "restart" and at in above:
                above[at][1] += 1
            else:
                mine = [cell, 1, span]
                row.append(mine)
                above.pop(at, None)
                if merge is not None:
                    above[at] = mine
            at += span
        rows.append(row)
    return ir.table([[(c, d, a) for c, d, a in r] for r in rows])


# -- presentations -----------------------------------------------------------


def pptx_document(data: bytes, **_) -> Document:
    pkg = Package(data)
    main = next((t for t, k, _ in pkg.relations("").values() if k == "officeDocument"), "ppt/presentation.xml")
    root, rels, doc = pkg.xml(main), pkg.relations(main), Document()
    if root is None:
        raise ConversionError("malformed")
    _properties(pkg, doc)
    ids = child(root, "sldIdLst")
    for number, s in enumerate(ids if ids is not None else (), 1):
        rel = next((v for k, v in s.attrib.items() if k.startswith("{") and k.endswith("}id")), None)
        part = rels.get(rel, ("",))[0]
        slide = pkg.xml(part)
        if slide is None or slide.get("show") == "0":
            continue
        own = pkg.relations(part)
        title, shapes = None, []
        for sp in slide.iter():
            kind = local(sp)
            if kind not in ("sp", "graphicFrame", "pic"):
                continue
            hidden = next((x for x in sp.iter() if local(x) == "cNvPr"), None)
            if hidden is not None and hidden.get("hidden") == "1":
                continue
            off = next((x for x in sp.iter() if local(x) == "off"), None)
            place = (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (0, 0)
            ph = next((x for x in sp.iter() if local(x) == "ph"), None)
            blocks: list[dict] = []
            if kind == "pic":
                blip = next((x for x in sp.iter() if local(x) == "blip"), None)
                target = own.get(attr(blip, "embed") or "") if blip is not None else None
                if target and (content := pkg.read(target[0])):
                    blocks.append(asset(doc, content, _IMAGES.get(target[0].rpartition(".")[2].lower(), "application/octet-stream"), (hidden.get("descr") or "") if hidden is not None else ""))
            elif kind == "graphicFrame":
                rows = [[_slide_runs(tc, own) for tc in tr if local(tc) == "tc"] for tr in sp.iter() if local(tr) == "tr"]
                if rows:
                    blocks.append(ir.table(rows, header=True))
            else:
                paras = [(p, _slide_runs(p, own)) for p in sp.iter() if local(p) == "p"]
                paras = [(p, r) for p, r in paras if r]
                if ph is not None and ph.get("type") in ("title", "ctrTitle"):
                    title = " ".join(ir.plain(r) for _, r in paras) or title
                    continue
                level = lambda p: int(child(p, "pPr").get("lvl", "0")) if child(p, "pPr") is not None else 0
                if ph is not None and ph.get("type") in (None, "body", "obj") and len(paras) > 1:
                    blocks.append(_nest([(level(p), False, [ir.paragraph(*r)]) for p, r in paras]))
                elif ph is None or ph.get("type") not in ("dt", "ftr", "sldNum"):
                    blocks += [ir.paragraph(*r) for _, r in paras]
            if blocks:
                shapes.append((place, len(shapes), blocks))
        body = [b for _, _, bs in sorted(shapes, key=lambda s: s[:2]) for b in bs]
        notes = next((t for t, k, _ in own.values() if k == "notesSlide"), None)
        if notes and (sheet := pkg.xml(notes)) is not None:
            said = [ir.paragraph(*r) for sp in sheet.iter() if local(sp) == "sp" and any(local(x) == "ph" and x.get("type") == "body" for x in sp.iter()) for p in sp.iter() if local(p) == "p" and (r := _slide_runs(p, {}))]
            if said:
                body += [ir.heading(3, ir.text("Speaker notes")), *said]
        doc.blocks.append(ir.container("slide", body, title, number))
    return doc


def _slide_runs(p, rels: dict) -> list[ir.Run]:
    out: list[ir.Run] = []
    for r in p.iter():
        if local(r) == "br":
            out.append(ir.BREAK)
        elif local(r) in ("r", "fld"):
            props = child(r, "rPr")
            marks = {m for k, m in (("b", "strong"), ("i", "emphasis")) if props is not None and props.get(k) in ("1", "true")}
            click = child(props, "hlinkClick") if props is not None else None
            target = rels.get(attr(click, "id") or "") if click is not None else None
            t = child(r, "t")
            if t is not None and t.text:
                out.append((t.text, frozenset(marks), target[0] if target and target[2] else None))
    return out


# -- workbooks ---------------------------------------------------------------


def cell_place(ref: str) -> tuple[int, int]:
    """"B3" -> (2, 1)."""
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?(\d+)", ref)
    if not m:
        raise ConversionError("malformed")
    col = 0
    for ch in m[1].upper():
        col = col * 26 + ord(ch) - 64
    return int(m[2]) - 1, col - 1


def cell_name(row: int, col: int) -> str:
    s = ""
    col += 1
    while col:
        col, r = divmod(col - 1, 26)
        s = chr(65 + r) + s
    return f"{s}{row + 1}"


def workbook_cells(data: bytes) -> tuple[list[tuple[str, dict[tuple[int, int], str], list[tuple[int, int, int, int]]]], Document]:
    """Visible sheets in order: (name, cells as shown, merged ranges)."""
    pkg, doc = Package(data), Document()
    main = next((t for t, k, _ in pkg.relations("").values() if k == "officeDocument"), "xl/workbook.xml")
    book, rels = pkg.xml(main), pkg.relations(main)
    if book is None:
        raise ConversionError("malformed")
    _properties(pkg, doc)
    folder = posixpath.dirname(main)
    strings = ["".join(t.text or "" for t in si.iter() if local(t) == "t" and True) for si in _children(pkg.xml(f"{folder}/sharedStrings.xml")) if local(si) == "si"]
    styles = pkg.xml(f"{folder}/styles.xml")
    custom, dates = {}, []
    if styles is not None:
        custom = {f.get("numFmtId"): f.get("formatCode", "") for f in styles.iter() if local(f) == "numFmt"}
        xfs = child(styles, "cellXfs")
        for xf in xfs if xfs is not None else ():
            k = xf.get("numFmtId", "0")
            f = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get(k, ""))
            dates.append("time" if k in ("18", "19", "20", "21", "45", "46", "47") else "both" if k == "22" else "date" if k in ("14", "15", "16", "17") else ("both" if re.search("[hs]", f, re.I) and re.search("[yd]", f, re.I) else "time" if re.search("[hs]", f, re.I) else "date" if re.search("[yd]", f, re.I) else None))
    late = next((e.get("date1904") in ("1", "true") for e in book.iter() if local(e) == "workbookPr"), False)
    out = []
    for s in (e for e in book.iter() if local(e) == "sheet"):
        if s.get("state") in ("hidden", "veryHidden"):
            continue
        rel = next((v for k, v in s.attrib.items() if k.startswith("{") and k.endswith("}id")), None)
        sheet = pkg.xml(rels.get(rel, ("",))[0])
        cells: dict[tuple[int, int], str] = {}
        merges = []
        at = (0, -1)
        for e in sheet.iter() if sheet is not None else ():
            if local(e) == "row":
                at = (int(e.get("r", at[0] + 2)) - 1, -1)
            elif local(e) == "c":
                at = cell_place(e.get("r")) if e.get("r") else (at[0], at[1] + 1)
                value, kind = child(e, "v"), e.get("t", "n")
                raw = value.text if value is not None and value.text is not None else ""
                if kind == "s" and raw:
                    raw = strings[int(raw)] if int(raw) < len(strings) else ""
                elif kind == "inlineStr":
                    raw = "".join(t.text or "" for t in e.iter() if local(t) == "t")
                elif kind == "b":
                    raw = "TRUE" if raw == "1" else "FALSE"
                elif kind == "n" and raw:
                    style = int(e.get("s", "0"))
                    raw = excel_value(float(raw), dates[style] if style < len(dates) else None, late)
                if raw:
                    cells[at] = raw
            elif local(e) == "mergeCell":
                a, _, b = e.get("ref", "A1").partition(":")
                merges.append((*cell_place(a), *cell_place(b or a)))
        out.append((s.get("name", ""), cells, merges))
    return out, doc


def excel_value(x: float, shown: str | None, late: bool = False) -> str:
    if shown:
        start = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
        try:
            t = start + timedelta(seconds=round(x * 86400))
        except OverflowError:
            shown = None
        else:
            return {"date": f"{t:%Y-%m-%d}", "time": f"{t:%H:%M:%S}", "both": f"{t:%Y-%m-%d %H:%M:%S}"}[shown]
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def regions(cells: dict[tuple[int, int], str], merges: list) -> list[tuple[int, int, int, int]]:
    """Boxes of cells that are divided from each other by empty rows."""
    rows = sorted({r for r, _ in cells} | {r for r1, _, r2, _ in merges for r in range(r1, r2 + 1)})
    out, first = [], None
    for i, r in enumerate(rows):
        first = r if first is None else first
        if i + 1 == len(rows) or rows[i + 1] > r + 1:
            cols = [c for y, c in cells if first <= y <= r]
            if cols:
                out.append((first, min(cols), r, max(cols)))
            first = None
    return out


def xlsx_document(data: bytes, **_) -> Document:
    sheets, doc = workbook_cells(data)
    for name, cells, merges in sheets:
        body = []
        for r1, c1, r2, c2 in regions(cells, merges):
            covered = {(r, c) for a, b, x, y in merges for r in range(a, x + 1) for c in range(b, y + 1)} - {(a, b) for a, b, _, _ in merges}
            spans = {(a, b): (x - a + 1, y - b + 1) for a, b, x, y in merges}
            rows = [[(ir.lines(cells.get((r, c), "")), *spans.get((r, c), (1, 1))) for c in range(c1, c2 + 1) if (r, c) not in covered] for r in range(r1, r2 + 1)]
            body.append(ir.table(rows))
        doc.blocks.append(ir.container("sheet", body, name))
    return doc


# -- OpenDocument ------------------------------------------------------------


def odf_document(data: bytes, **_) -> Document:
    pkg = Package(data)
    kind = (pkg.read("mimetype") or b"").decode("ascii", "replace").strip()
    root, meta = pkg.xml("content.xml"), pkg.xml("meta.xml")
    if root is None:
        raise ConversionError("malformed")
    doc = Document()
    for e in meta.iter() if meta is not None else ():
        if local(e) == "title" and e.text:
            doc.title = e.text
        elif local(e) in ("creator", "initial-creator") and e.text and not doc.authors:
            doc.authors.append(e.text)
    styles: dict[str, frozenset] = {}
    for s in root.iter():
        if local(s) == "style" and (props := child(s, "text-properties")) is not None:
            marks = {m for k, v, m in (("font-weight", "bold", "strong"), ("font-style", "italic", "emphasis")) if attr(props, k) == v}
            marks |= {"strike"} if (attr(props, "text-line-through-style") or "none") != "none" else set()
            styles[attr(s, "name")] = frozenset(marks)

    def runs(e, marks=ir.NONE, link=None) -> list[ir.Run]:
        out: list[ir.Run] = [(e.text, marks, link)] if e.text else []
        for c in e:
            k = local(c)
            if k == "line-break":
                out.append(ir.BREAK)
            elif k == "s":
                out.append((" " * int(attr(c, "c", "1")), marks, link))
            elif k == "tab":
                out.append(("\t", marks, link))
            elif k == "a":
                out += runs(c, marks, attr(c, "href"))
            elif k not in ("note", "annotation", "frame"):
                out += runs(c, marks | styles.get(attr(c, "style-name"), ir.NONE), link)
            if c.tail:
                out.append((c.tail, marks, link))
        return out

    def images(e) -> list[dict]:
        out = []
        for i in e.iter():
            if local(i) == "image" and (href := attr(i, "href")) and (content := pkg.read(href)):
                out.append(asset(doc, content, _IMAGES.get(href.rpartition(".")[2].lower(), "application/octet-stream")))
        return out

    def body(parent) -> list[dict]:
        out: list[dict] = []
        for e in parent:
            k = local(e)
            if k == "h":
                out.append(ir.heading(int(attr(e, "outline-level", "1")), *runs(e)))
            elif k == "p":
                r = runs(e)
                out += ([ir.paragraph(*r)] if r else []) + images(e)
            elif k == "list":
                items = [b for i in e if local(i) in ("list-item", "list-header") for b in [body(i)] if b]
                out += [ir.bullet_list(items)] if items else []
            elif k == "table":
                out.append(sheet_table(e))
            elif k in ("section", "text-box", "frame", "custom-shape", "g", "index-body", "table-of-content"):
                out += body(e) + (images(e) if k == "frame" else [])
        return out

    def sheet_table(e) -> dict:
        rows = []
        for tr in (x for x in e.iter() if local(x) == "table-row"):
            row = []
            for c in tr:
                if local(c) not in ("table-cell", "covered-table-cell"):
                    continue
                cell: list[ir.Run] = []
                for p in (x for x in c if local(x) in ("p", "h")):
                    cell += [ir.BREAK] * (2 * bool(cell)) + runs(p)
                if not cell and attr(c, "value"):
                    cell = [ir.text(attr(c, "value"))]
                again = int(attr(c, "number-columns-repeated", "1"))
                if local(c) == "covered-table-cell":
                    row += [None] * min(again, 1024)
                else:
                    row += [(cell, int(attr(c, "number-rows-spanned", "1")), int(attr(c, "number-columns-spanned", "1")))] * min(again, 1024)
            rows += [row] * min(int(attr(tr, "number-rows-repeated", "1")), 1024)
        full = lambda r: [i for i, c in enumerate(r) if c is None or c[0]]
        while rows and not full(rows[-1]):
            rows.pop()
        width = max((max(full(r), default=-1) + 1 for r in rows), default=0)
        return ir.table([[c for c in r[:width] if c is not None] for r in rows])

    office = child(root, "body")
    content = office[0] if office is not None and len(office) else ()
    if "spreadsheet" in kind or local(content) == "spreadsheet":
        for t in (x for x in content if local(x) == "table"):
            doc.blocks.append(ir.container("sheet", [sheet_table(t)], attr(t, "name", "")))
    elif "presentation" in kind or local(content) == "presentation":
        for n, page in enumerate((x for x in content if local(x) == "page"), 1):
            said = child(page, "notes")
            frames = [x for x in page if local(x) != "notes"]
            titles = [f for f in frames if attr(f, "class") == "title"]
            title = " ".join(" ".join("".join(t.itertext()).split()) for t in titles) or None
            inside = body([f for f in frames if f not in titles])
            words = body(said) if said is not None else []
            doc.blocks.append(ir.container("slide", inside + ([ir.heading(3, ir.text("Speaker notes")), *words] if words else []), title, n))
    else:
        doc.blocks = body(content)
    return doc


# -- books and archives ------------------------------------------------------


def epub_document(data: bytes, **_) -> Document:
    pkg = Package(data)
    box = pkg.xml("META-INF/container.xml")
    if pkg.read("META-INF/encryption.xml"):
        raise ConversionError("encrypted")
    path = next((attr(e, "full-path") for e in box.iter() if local(e) == "rootfile"), None) if box is not None else None
    opf = pkg.xml(path) if path else None
    if opf is None:
        raise ConversionError("malformed")
    folder, doc = posixpath.dirname(path), Document()
    for e in opf.iter():
        if local(e) == "title" and e.text and doc.title is None:
            doc.title = e.text
        elif local(e) == "creator" and e.text:
            doc.authors.append(e.text)
    resolve = lambda href: posixpath.normpath(posixpath.join(folder, urllib.parse.unquote(href.partition("#")[0])))
    manifest = {e.get("id"): e for e in opf.iter() if local(e) == "item"}
    nav = next((e for e in manifest.values() if "nav" in (e.get("properties") or "").split()), None)
    if nav is not None and (page := pkg.read(resolve(nav.get("href", "")))):
        blocks = [b for b in html_blocks(re.sub(r"</?nav\b[^>]*>", "", page.decode("utf-8", "replace"))) if b["kind"] == "list"]
        if blocks:
            doc.blocks += [ir.heading(1, ir.text("Contents")), *blocks]
    for ref in (e for e in opf.iter() if local(e) == "itemref"):
        item, seen = manifest.get(ref.get("idref")), set()
        while item is not None and item.get("media-type") not in ("application/xhtml+xml", "text/html") and item.get("fallback") not in seen:
            seen.add(item.get("fallback"))
            item = manifest.get(item.get("fallback"))
        if item is None or item is nav or ref.get("linear") == "no":
            continue
        page = pkg.read(resolve(item.get("href", "")))
        if page is None:
            doc.diagnostics.append(("epub.missingSpineItem", "warning", item.get("href", "")))
            continue
        doc.blocks += html_blocks(page.decode("utf-8", "replace"))
    return doc


def safe_member(name: str) -> bool:
    """A name that stays within the archive on any system."""
    return bool(name) and not name.startswith(("/", "\\")) and not re.search(r'[\x00-\x1f<>:"|?*\\]', name) and ".." not in name.split("/")


def zip_members(data: bytes) -> list[tuple[str, bytes]]:
    """Members in order of their names; directories and unsafe names are left out."""
    pkg = Package(data)
    return [(n, pkg.read(n)) for n in sorted(pkg.names) if not n.endswith("/") and safe_member(n)]


def image_size(data: bytes) -> tuple[str, int, int] | None:
    """Media type, width and height from an image's header."""
    if data.startswith(b"\x89PNG\r\n\x1a\n") and len(data) >= 24:
        return ("image/png", *struct.unpack(">II", data[16:24]))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("image/gif", *struct.unpack("<HH", data[6:10]))
    if data.startswith(b"BM") and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return "image/bmp", w, abs(h)
    if data.startswith(b"\xff\xd8"):
        i = 2
        while i + 9 < len(data) and data[i] == 0xFF:
            if 0xC0 <= data[i + 1] <= 0xCF and data[i + 1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[i + 5 : i + 9])
                return "image/jpeg", w, h
            i += 2 + struct.unpack(">H", data[i + 2 : i + 4])[0]
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return "image/webp", int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if data[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return "image/webp", w & 0x3FFF, h & 0x3FFF
    return None


def image_document(data: bytes, name: str | None = None, **_) -> Document:
    found, doc = image_size(data), Document()
    if found is None:
        raise ConversionError("malformed")
    if found[1] <= 0 or found[2] <= 0:
        raise ConversionError("malformed")
    doc.blocks.append(ir.container("page", [asset(doc, data, found[0], name or "")], None, 1))
    doc.properties |= {"image.width": str(found[1]), "image.height": str(found[2])}
    return doc
