"""Compound-file formats, from files written here byte by byte."""

import struct

import pytest

from docloom.plans.convert import convert, guess, parse
from docloom.plans.ir import ConversionError, render
from docloom.sources import compound

END, FREE = 0xFFFFFFFE, 0xFFFFFFFF


def write_compound(streams: dict[str, bytes]) -> bytes:
    """A compound file without mini streams; storages by "/" in the names."""
    storages = sorted({n.partition("/")[0] for n in streams if "/" in n})
    top = [n for n in streams if "/" not in n] + storages
    order = ["", *top] + [n for n in streams if "/" in n]
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        first = len(sectors)
        n = max(1, -(-len(data) // 512))
        for i in range(n):
            sectors.append(data[512 * i : 512 * (i + 1)].ljust(512, b"\0"))
            fat.append(first + i + 1 if i + 1 < n else END)
        return first

    starts = {n: put(d) for n, d in streams.items()}
    entries = b""
    for i, name in enumerate(order):
        group = top if name in top else [n for n in streams if "/" in n and n.partition("/")[0] == name.partition("/")[0]]
        after = group[group.index(name) + 1] if name and group.index(name) + 1 < len(group) else None
        short = "Root Entry" if not name else name.rpartition("/")[2]
        child = 1 if not name else order.index(next(n for n in streams if n.startswith(name + "/"))) if name in storages else FREE
        kind = 5 if not name else 1 if name in storages else 2
        raw = short.encode("utf-16-le")
        e = raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, FREE, order.index(after) if after else FREE, child) + b"\0" * 36
        e += struct.pack("<IQ", starts.get(name, END), len(streams.get(name, b"")))
        entries += e
        assert len(e) == 128 and i < 64
    first_dir = put(entries)
    at = len(sectors)
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff"))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, first_dir, 0, 0, END, 0, END, 0)
    head += struct.pack("<109I", at, *[FREE] * 108)
    return head + b"".join(sectors)


def md(fmt: str, data: bytes) -> str:
    return render(parse(fmt, data))


def test_message():
    wide = lambda s: s.encode("utf-16-le")
    data = write_compound({"__properties_version1.0": b"\0" * 32, "__substg1.0_0037001F": wide("Subject"), "__substg1.0_0C1A001F": wide("Ann"), "__substg1.0_1000001F": wide("Hello\r\nthere\r\n\r\nBye"), "__recip_version1.0_#00000000/__substg1.0_3001001F": wide("Bob"), "__attach_version1.0_#00000000/__substg1.0_3707001F": wide("a.txt")})
    assert compound.kind_of(data) == "msg" and guess("x", data) == "msg"
    assert md("msg", data) == "# Subject\n\n**From:** Ann\n\n**To:** Bob\n\nHello  \nthere\n\nBye\n\n## Attachments\n\n- a.txt\n"


def test_compressed_rtf():
    plain = b"{\\rtf1 Hi\\par}"
    stored = struct.pack("<IIII", len(plain) + 12, len(plain), 0x414C454D, 0) + plain
    assert compound.rtf_unpacked(stored) == plain
    body = b"\x00" + b"abcdefgh" + b"\x01" + struct.pack(">H", (207 % 4096) << 4 | 6)
    packed = struct.pack("<IIII", len(body) + 12, 16, 0x75465A4C, 0) + body
    assert compound.rtf_unpacked(packed) == b"abcdefghabcdefgh"


def test_binary_document():
    text = "Head\rcell\x07" + "wide é\r"
    main = bytearray(1024)
    struct.pack_into("<H", main, 10, 0x0200)
    struct.pack_into("<I", main, 0x4C, len(text))
    main[512:522] = text[:10].encode("cp1252")
    main[600 : 600 + 14] = text[10:].encode("utf-16-le")
    pieces = struct.pack("<III", 0, 10, 17) + struct.pack("<HIH", 0, 0x40000000 | 1024, 0) + struct.pack("<HIH", 0, 600, 0)
    clx = b"\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    data = write_compound({"WordDocument": bytes(main), "1Table": clx})
    assert compound.kind_of(data) == "doc"
    assert md("doc", data) == "Head\n\ncell\n\nwide é\n"
    struct.pack_into("<H", main, 10, 0x0300)
    with pytest.raises(ConversionError) as e:
        parse("doc", write_compound({"WordDocument": bytes(main), "1Table": clx}))
    assert e.value.code == "encrypted"


def test_binary_workbook():
    rec = lambda k, b: struct.pack("<HH", k, len(b)) + b
    sst = struct.pack("<II", 2, 2) + struct.pack("<HB", 4, 0) + b"name" + struct.pack("<HB", 2, 1) + "é1".encode("utf-16-le")
    sheet = rec(0x0809, b"\0" * 16) + rec(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + rec(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)) + rec(0x203, struct.pack("<HHHd", 1, 0, 0, 2.5)) + rec(0x27E, struct.pack("<HHHI", 1, 1, 0, 7 << 2 | 2)) + rec(0x0A, b"")
    globals_ = lambda at: rec(0x0809, b"\0" * 16) + rec(0x85, struct.pack("<IBBBB", at, 0, 0, 4, 0) + b"Data") + rec(0xFC, sst) + rec(0x0A, b"")
    data = write_compound({"Workbook": globals_(len(globals_(0))) + sheet})
    assert compound.kind_of(data) == "xls"
    assert md("xls", data) == "## Sheet: Data\n\n|  |  |\n| --- | --- |\n| name | é1 |\n| 2.5 | 7 |\n"


def test_binary_presentation():
    rec = lambda v, k, b: struct.pack("<HHI", v, k, len(b)) + b
    texts = rec(0, 0x03F3, b"\0" * 20) + rec(0, 0x0FA8, b"Title") + rec(0, 0x0FA0, "Böd\ry".encode("utf-16-le")) + rec(0, 0x03F3, b"\0" * 20) + rec(0, 0x0FA8, b"Next")
    data = write_compound({"PowerPoint Document": rec(15, 0x03E8, rec(15, 0x0FF0, texts))})
    assert compound.kind_of(data) == "ppt"
    assert md("ppt", data) == "## Slide 1: Title\n\nBöd\n\ny\n\n## Slide 2: Next\n"


def test_circles_and_cuts_are_malformed():
    data = bytearray(write_compound({"WordDocument": b"x" * 2000}))
    for bad in (bytes(data[:600]), b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", bytes(data[:76]) + b"\0" * 436 + bytes(data[512:])):
        with pytest.raises((ConversionError, struct.error, IndexError)):
            parse("doc", bad)


def test_detection_of_compound_files(spark):
    data = write_compound({"PowerPoint Document": b"\0" * 16})
    docs = spark.createDataFrame([("a", "noname", None, data), ("b", "x.doc", None, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1broken")], "doc_id string, source_name string, media_type string, content binary")
    got = {r["doc_id"]: (r["format"], r["error_code"]) for r in convert(docs).collect()}
    assert got == {"a": ("ppt", None), "b": ("doc", "malformed")}
