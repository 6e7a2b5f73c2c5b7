"""Parsers of compound-file formats: messages, binary documents, workbooks and presentations.

Nothing in a file is executed; chains are followed with bounds, so a file that
points in circles is malformed and no more.
"""

from __future__ import annotations

import re
import struct

from docloom.plans import ir
from docloom.plans.ir import ConversionError, Document

_FREE = 0xFFFFFFFA
MAX_STREAM = 64 << 20


class CompoundFile:
    """Streams of an OLE compound file by their paths."""

    def __init__(self, data: bytes):
        if len(data) < 512 or data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise ConversionError("malformed")
        self.data = data
        self.sector = 1 << struct.unpack_from("<H", data, 30)[0]
        self.mini = 1 << struct.unpack_from("<H", data, 32)[0]
        if self.sector not in (512, 4096) or self.mini != 64:
            raise ConversionError("malformed")
        n_fat, first_dir = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
        self.cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<IIIII", data, 56)
        difat = list(struct.unpack_from("<109I", data, 76))
        at, seen = first_difat, 0
        while at < _FREE and seen < min(n_difat, 4096):
            part = struct.unpack(f"<{self.sector // 4}I", self._raw(at))
            difat += part[:-1]
            at, seen = part[-1], seen + 1
        self.fat: list[int] = []
        for s in [x for x in difat if x < _FREE][:n_fat]:
            self.fat += struct.unpack(f"<{self.sector // 4}I", self._raw(s))
        raw = self._chain(first_dir, None)
        self.entries = []
        for i in range(0, len(raw) - 127, 128):
            size = struct.unpack_from("<H", raw, i + 64)[0]
            name = raw[i : i + max(0, min(size, 64) - 2)].decode("utf-16-le", "replace")
            left, right, child = struct.unpack_from("<III", raw, i + 68)
            start, length = struct.unpack_from("<IQ", raw, i + 116)
            self.entries.append((name, raw[i + 66], left, right, child, start, length & 0xFFFFFFFF))
        if not self.entries:
            raise ConversionError("malformed")
        root = self.entries[0]
        mini_fat = self._chain(first_mini, None) if first_mini < _FREE else b""
        self.mini_fat = struct.unpack(f"<{len(mini_fat) // 4}I", mini_fat[: len(mini_fat) // 4 * 4])
        self.mini_data = self._chain(root[5], root[6]) if root[5] < _FREE else b""
        self.paths: dict[str, int] = {}
        self._walk(root[4], "", set())

    def _raw(self, sector: int) -> bytes:
        at = (sector + 1) * self.sector
        out = self.data[at : at + self.sector]
        if len(out) < self.sector:
            out = out.ljust(self.sector, b"\0") if out else _fail()
        return out

    def _chain(self, at: int, size: int | None) -> bytes:
        out, n = [], 0
        while at < _FREE:
            if n > len(self.data) // self.sector + 1 or at >= len(self.fat):
                raise ConversionError("malformed")
            out.append(self._raw(at))
            at, n = self.fat[at], n + 1
        joined = b"".join(out)
        return joined if size is None else joined[:size]

    def _walk(self, i: int, prefix: str, seen: set[int]) -> None:
        todo = [(i, prefix)]
        while todo:
            i, prefix = todo.pop()
            if i >= len(self.entries) or i in seen:
                continue
            seen.add(i)
            name, kind, left, right, child, _, _ = self.entries[i]
            if kind == 2:
                self.paths[prefix + name] = i
            todo += [(left, prefix), (right, prefix)]
            if kind == 1:
                todo.append((child, prefix + name + "/"))

    def read(self, path: str) -> bytes | None:
        i = self.paths.get(path)
        if i is None:
            return None
        _, _, _, _, _, start, size = self.entries[i]
        if size > MAX_STREAM:
            raise ConversionError("resourceLimit", limit="max_archive_member_bytes")
        if size >= self.cutoff:
            return self._chain(start, size)
        out, n = [], 0
        while start < _FREE and n * self.mini < size:
            if start >= len(self.mini_fat):
                raise ConversionError("malformed")
            out.append(self.mini_data[start * self.mini : (start + 1) * self.mini])
            start, n = self.mini_fat[start], n + 1
        return b"".join(out)[:size]


def _fail():
    raise ConversionError("malformed")


def kind_of(data: bytes) -> str | None:
    """msg, doc, xls or ppt by the streams of a compound file."""
    try:
        names = set(CompoundFile(data).paths)
    except (ConversionError, struct.error):
        return None
    for name, kind in (("__properties_version1.0", "msg"), ("WordDocument", "doc"), ("Workbook", "xls"), ("Book", "xls"), ("PowerPoint Document", "ppt")):
        if name in names:
            return kind
    return None


# -- messages ----------------------------------------------------------------


def rtf_unpacked(data: bytes) -> bytes:
    """The text of a compressed RTF stream."""
    if len(data) < 16:
        raise ConversionError("malformed")
    size, raw, kind = struct.unpack_from("<III", data)
    if kind == 0x414C454D:  # stored
        return data[16 : 16 + raw]
    start = (
        b"{\\rtf1\\ansi\\mac\\deff0\\deftab720{\\fonttbl;}{\\f0\\fnil \\froman \\fswiss \\fmodern \\fscript \\fdecor MS Sans SerifSymbolArialTimes New RomanCourier"
        b"{\\colortbl\\red0\\green0\\blue0\r\n\\par \\pard\\plain\\f0\\fs20\\b\\i\\u\\tab\\tx"
    )  # the fixed beginning of the dictionary
    ring = bytearray(start.ljust(4096, b"\0"))
    at, out, i, end = len(start), bytearray(), 16, min(len(data), size + 4)
    while i < end and len(out) < raw:
        flags = data[i]
        i += 1
        for bit in range(8):
            if i >= end or len(out) >= raw:
                break
            if flags >> bit & 1:
                if i + 1 >= end:
                    break
                ref = data[i] << 8 | data[i + 1]
                i += 2
                offset, n = ref >> 4, (ref & 15) + 2
                if offset == at % 4096:
                    return bytes(out)
                for k in range(n):
                    c = ring[(offset + k) % 4096]
                    out.append(c)
                    ring[at % 4096] = c
                    at += 1
            else:
                out.append(data[i])
                ring[at % 4096] = data[i]
                at, i = at + 1, i + 1
    return bytes(out)


def msg_document(data: bytes, depth: int = 0, **_) -> Document:
    """Headers, the best body (HTML, RTF, plain) and the names of attachments."""
    from docloom.sources.html import html_blocks
    from docloom.sources.text_formats import rtf_document

    box = CompoundFile(data)

    def prop(folder: str, tag: str) -> str | None:
        wide, narrow = box.read(f"{folder}__substg1.0_{tag}001F"), box.read(f"{folder}__substg1.0_{tag}001E")
        return wide.decode("utf-16-le", "replace").rstrip("\0") if wide is not None else narrow.decode("cp1252", "replace").rstrip("\0") if narrow is not None else None

    if "__properties_version1.0" not in box.paths:
        raise ConversionError("malformed")
    doc = Document(title=prop("", "0037"))
    if doc.title:
        doc.blocks.append(ir.heading(1, ir.text(doc.title)))
    sender = " ".join(x for x in (prop("", "0C1A"), f"<{prop('', '0C1F')}>" if prop("", "0C1F") else None) if x)
    folders = sorted({p.rpartition("/")[0] for p in box.paths if p.startswith("__recip_version1.0")})
    to = [prop(f + "/", "3001") or prop(f + "/", "3003") for f in folders]
    for label, value in (("From", sender), ("To", ", ".join(x for x in to if x) or prop("", "0E04") or "")):
        if value:
            doc.blocks.append(ir.paragraph(ir.text(f"{label}: ", "strong"), ir.text(value)))
    html, rtf, plain = box.read("__substg1.0_10130102"), box.read("__substg1.0_10090102"), prop("", "1000")
    if html:
        doc.blocks += html_blocks(html.decode("utf-8", "replace"))
    elif rtf:
        doc.blocks += rtf_document(rtf_unpacked(rtf)).blocks
    elif plain:
        doc.blocks += [ir.paragraph(*ir.lines(p)) for p in re.split(r"(?:\r?\n){2,}", plain) if p.strip()]
    names = [prop(f + "/", "3707") or prop(f + "/", "3704") or "attachment" for f in sorted({p.split("/")[0] for p in box.paths if p.startswith("__attach_version1.0")})]
    if names:
        doc.blocks += [ir.heading(2, ir.text("Attachments")), ir.bullet_list([[ir.paragraph(ir.text(n))] for n in names])]
    return doc


# -- binary office documents -------------------------------------------------


def doc_document(data: bytes, **_) -> Document:
    """The text of a binary word-processing document, by its piece table."""
    box = CompoundFile(data)
    main = box.read("WordDocument") or _fail()
    if len(main) < 0x1AA:
        raise ConversionError("malformed")
    flags = struct.unpack_from("<H", main, 10)[0]
    if flags & 0x0100:
        raise ConversionError("encrypted")
    table = box.read("1Table" if flags & 0x0200 else "0Table") or _fail()
    at, size = struct.unpack_from("<II", main, 0x1A2)
    count = struct.unpack_from("<I", main, 0x4C)[0]
    clx, i = table[at : at + size], 0
    while i < len(clx) and clx[i] == 1:
        i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
    if i >= len(clx) or clx[i] != 2:
        raise ConversionError("malformed")
    n = (struct.unpack_from("<I", clx, i + 1)[0] - 4) // 12
    places = struct.unpack_from(f"<{n + 1}I", clx, i + 5)
    text = []
    for k in range(n):
        fc = struct.unpack_from("<I", clx, i + 5 + 4 * (n + 1) + 8 * k + 2)[0]
        chars = places[k + 1] - places[k]
        if fc & 0x40000000:
            start = (fc & 0x3FFFFFFF) // 2
            text.append(main[start : start + chars].decode("cp1252", "replace"))
        else:
            text.append(main[fc : fc + 2 * chars].decode("utf-16-le", "replace"))
    s = "".join(text)[: count or None]
    s = re.sub(r"\x13[^\x14\x15]*\x14?([^\x15]*)\x15", r"\1", s)  # fields: their results
    doc = Document()
    for part in re.split(r"[\r\x07\x0c]", s):  # ends of paragraphs, cells and pages
        clean = re.sub(r"[\x00-\x08\x0e-\x1f]", "", part.replace("\x0b", "\n")).strip(" ")
        if clean:
            doc.blocks.append(ir.paragraph(*ir.lines(clean)))
    return doc


def _biff_string(data: bytes, i: int, wide_count: bool, bounds: list[int]) -> tuple[str, int]:
    """A string of a BIFF8 record; `bounds` are where its continuations begin, each with a new width flag."""
    n = struct.unpack_from("<H" if wide_count else "<B", data, i)[0]
    i += 2 if wide_count else 1
    flags = data[i]
    i += 1
    runs = ext = 0
    if flags & 8:
        runs = struct.unpack_from("<H", data, i)[0]
        i += 2
    if flags & 4:
        ext = struct.unpack_from("<I", data, i)[0]
        i += 4
    out, wide = [], flags & 1
    while n > 0:
        limit = next((b for b in bounds if b > i), len(data))
        take = min(n, (limit - i) // (2 if wide else 1))
        out.append(data[i : i + take * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1", "replace"))
        i += take * (2 if wide else 1)
        n -= take
        if n > 0:
            if i >= len(data):
                raise ConversionError("malformed")
            wide = data[i] & 1
            i += 1
    return "".join(out), i + 4 * runs + ext


def _rk(x: int) -> float:
    v = float(x >> 2 if x < 1 << 31 else (x >> 2) - (1 << 30)) if x & 2 else struct.unpack("<d", struct.pack("<Q", (x & 0xFFFFFFFC) << 32))[0]
    return v / 100 if x & 1 else v


def xls_document(data: bytes, **_) -> Document:
    from docloom.sources.packages import excel_value, regions

    box = CompoundFile(data)
    stream = box.read("Workbook") or box.read("Book") or _fail()
    strings: list[str] = []
    sheets: list[tuple[int, str, int]] = []
    cells: dict[int, dict] = {}
    at, now, pending = 0, -1, None
    while at + 4 <= len(stream):
        start = at
        kind, size = struct.unpack_from("<HH", stream, at)
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0x2F:
            raise ConversionError("encrypted")
        if kind == 0x0809:
            now = start
            cells[now] = {}
        elif kind == 0x85 and len(body) > 8:
            sheets.append((struct.unpack_from("<I", body)[0], _biff_string(body, 6, False, [])[0], body[4]))
        elif kind == 0xFC:
            parts, bounds = [body], []
            while at + 4 <= len(stream) and struct.unpack_from("<H", stream, at)[0] == 0x3C:
                n = struct.unpack_from("<H", stream, at + 2)[0]
                bounds.append(sum(map(len, parts)))
                parts.append(stream[at + 4 : at + 4 + n])
                at += 4 + n
            joined, i = b"".join(parts), 8
            for _ in range(struct.unpack_from("<I", body, 4)[0]):
                if i >= len(joined):
                    break
                s, i = _biff_string(joined, i, True, bounds)
                strings.append(s)
        elif kind in (0xFD, 0x203, 0x27E, 0x06, 0x205, 0x204) and len(body) >= 8:
            r, c = struct.unpack_from("<HH", body)
            if kind == 0xFD:
                k = struct.unpack_from("<I", body, 6)[0]
                value = strings[k] if k < len(strings) else ""
            elif kind == 0x203:
                value = excel_value(struct.unpack_from("<d", body, 6)[0], None)
            elif kind == 0x27E:
                value = excel_value(_rk(struct.unpack_from("<I", body, 6)[0]), None)
            elif kind == 0x06:
                pending = (r, c) if body[12:14] == b"\xff\xff" and body[6] == 0 else None
                value = "" if pending else ("TRUE" if body[8] else "FALSE") if body[12:14] == b"\xff\xff" and body[6] == 1 else "" if body[12:14] == b"\xff\xff" else excel_value(struct.unpack_from("<d", body, 6)[0], None)
            elif kind == 0x205:
                value = ("TRUE" if body[6] else "FALSE") if not body[7] else "#ERROR"
            else:
                value = _biff_string(body, 6, True, [])[0]
            if value:
                cells.setdefault(now, {})[(r, c)] = value
        elif kind == 0x207 and pending is not None:
            cells.setdefault(now, {})[pending] = _biff_string(body, 0, True, [])[0]
            pending = None
        elif kind == 0xBD and len(body) >= 6:
            r, c = struct.unpack_from("<HH", body)
            for k in range((len(body) - 6) // 6):
                cells.setdefault(now, {})[(r, c + k)] = excel_value(_rk(struct.unpack_from("<I", body, 4 + 6 * k + 2)[0]), None)
    doc = Document()
    for offset, name, hidden in sheets:
        found = cells.get(offset, {})
        if not hidden & 3:
            tables = [ir.table([[ir.lines(found.get((r, c), "")) for c in range(c1, c2 + 1)] for r in range(r1, r2 + 1)]) for r1, c1, r2, c2 in regions(found, [])]
            doc.blocks.append(ir.container("sheet", tables, name))
    return doc


def ppt_document(data: bytes, **_) -> Document:
    """Text atoms of a binary presentation, slide by slide in the order of its slide list."""
    stream = CompoundFile(data).read("PowerPoint Document") or _fail()
    slides: list[list[str]] = []
    loose: list[str] = []

    def atoms(lo: int, hi: int, depth: int, inside: bool) -> None:
        at = lo
        while at + 8 <= hi and depth < 32:
            head, kind, size = struct.unpack_from("<HHI", stream, at)
            body, end = at + 8, min(hi, at + 8 + size)
            if kind == 0x03F3 and inside:  # a slide's place in the list: its texts follow
                slides.append([])
            elif kind == 0x0FA0:
                (slides[-1] if slides and inside else loose).append(stream[body:end].decode("utf-16-le", "replace"))
            elif kind == 0x0FA8:
                (slides[-1] if slides and inside else loose).append(stream[body:end].decode("latin-1"))
            elif head & 15 == 15:
                atoms(body, end, depth + 1, inside or kind == 0x0FF0 and head >> 4 == 0)
            at = at + 8 + size

    atoms(0, len(stream), 0, False)
    doc = Document()
    for n, texts in enumerate(slides or ([loose] if loose else []), 1):
        parts = [p.strip() for t in texts for p in re.split(r"[\r\x0b]", t) if p.strip()]
        title = parts[0] if slides and parts else None
        doc.blocks.append(ir.container("slide", [ir.paragraph(ir.text(p)) for p in parts[1 if title else 0 :]], title, n))
    return doc
