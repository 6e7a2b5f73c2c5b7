"""Format detection: evidence, candidates, and the choice of a converter.

Evidence comes as rows (doc_id, format, confidence, priority, detector,
explicit); candidates are merged and ordered by windows, and converters are
joined by the formats they take.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Extensions and media types of each format (fixed values).
EXTENSIONS = {
    "text": "txt text log", "markdown": "md markdown mdown", "html": "html htm", "json": "json", "xml": "xml", "csv": "csv", "tsv": "tsv",
    "feed": "rss atom", "notebook": "ipynb", "docx": "docx docm", "pptx": "pptx pptm ppsx ppsm potx", "xlsx": "xlsx xlsm", "odf": "odt ods odp",
    "epub": "epub", "rtf": "rtf", "zip": "zip", "drawio": "drawio", "image": "png jpg jpeg gif webp bmp tif tiff", "pdf": "pdf", "rar": "rar",
    "doc": "doc", "ppt": "ppt", "xls": "xls", "msg": "msg", "audio": "mp3 wav flac ogg m4a", "video": "mp4 mkv webm mov",
}
MEDIA_TYPES = {
    "text/plain": "text", "text/markdown": "markdown", "text/html": "html", "application/xhtml+xml": "html", "application/json": "json", "application/xml": "xml", "text/xml": "xml",
    "text/csv": "csv", "text/tab-separated-values": "tsv", "application/rss+xml": "feed", "application/atom+xml": "feed", "application/x-ipynb+json": "notebook",
    "application/rtf": "rtf", "text/rtf": "rtf", "application/zip": "zip", "application/epub+zip": "epub", "application/pdf": "pdf", "image/png": "image", "image/jpeg": "image",
}
#: Converters: id, priority, formats.
CONVERTERS = (
    ("text", 100, ["text"]), ("delimited", 110, ["csv", "tsv"]), ("markdown", 120, ["markdown"]), ("structured", 200, ["json", "xml"]), ("html", 210, ["html"]),
    ("feed", 220, ["feed"]), ("zip", 220, ["zip"]), ("drawio", 220, ["drawio"]), ("epub", 240, ["epub"]), ("rtf", 240, ["rtf"]), ("odf", 245, ["odf"]),
    ("notebook", 250, ["notebook"]), ("docx", 250, ["docx"]), ("presentation", 250, ["pptx"]), ("workbook", 250, ["xlsx"]), ("image", 260, ["image"]),
    ("mediawiki", 200, ["mediawiki"]), ("legacy-office", 230, ["doc", "ppt", "xls"]), ("msg", 250, ["msg"]),
)
COMPOUND = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_CONF = {"drawio": 1.0, "docx": 0.91, "pptx": 0.91, "xlsx": 0.91, "odf": 0.91, "epub": 0.91, "markdown": 0.99, "csv": 0.99, "tsv": 0.99, "rar": 0.05}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))


def hint_evidence(docs: DataFrame) -> DataFrame:
    """Evidence of names and media types, by joins with small dimension tables."""
    spark = docs.sparkSession
    by_ext = spark.createDataFrame([(e, f) for f, es in EXTENSIONS.items() for e in es.split()], "ext string, by_name string")
    by_mime = spark.createDataFrame(list(MEDIA_TYPES.items()), "mime string, by_mime string")
    x = docs.select("doc_id", extension(F.col("source_name")).alias("ext"), F.lower(F.trim(F.split(F.coalesce("media_type", F.lit("")), ";")[0])).alias("mime"))
    x = x.join(F.broadcast(by_ext), "ext", "left").join(F.broadcast(by_mime), "mime", "left")  # fixed tables
    conf = F.lit(0.55)
    for f, c in _CONF.items():
        conf = F.when(F.col("by_name") == f, c).otherwise(conf)
    named = x.where("by_name is not null").select("doc_id", F.col("by_name").alias("format"), F.when(F.col("by_name") == F.col("by_mime"), F.greatest(conf, F.lit(0.68))).otherwise(conf).alias("confidence"))
    typed = x.where("by_mime is not null and (by_name is null or by_name <> by_mime)").select("doc_id", F.col("by_mime").alias("format"), F.lit(0.60).alias("confidence"))
    return named.unionByName(typed).select("doc_id", "format", "confidence", F.lit(100).alias("priority"), F.lit("hint").alias("detector"), F.lit(False).alias("explicit"))


def magic(content: Column) -> tuple[Column, Column]:
    """Format and confidence by the first bytes; null if none is known."""
    head = F.hex(F.substring(content, 1, 16))
    table = (
        (head.startswith("255044462D"), "pdf", 0.99), (head.startswith("7B5C727466"), "rtf", 0.99), (head.startswith("89504E470D0A1A0A"), "image", 0.98),
        (head.startswith("FFD8FF"), "image", 0.98), (head.startswith("474946383761") | head.startswith("474946383961"), "image", 0.98), (head.startswith("424D"), "image", 0.98),
        (head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image", 0.98), (head.startswith("49492A00") | head.startswith("4D4D002A"), "image", 0.98),
        (head.startswith("526172211A07"), "rar", 0.99), (head.startswith("664C6143") | head.startswith("494433"), "audio", 0.96),
        (head.startswith("52494646") & (F.substring(head, 17, 8) == "57415645"), "audio", 0.96), (head.startswith("1A45DFA3"), "video", 0.96), (F.substring(head, 9, 8) == "66747970", "video", 0.96),
    )
    fmt, conf = F.lit(None).cast("string"), F.lit(None).cast("double")
    for test, f, c in reversed(table):
        fmt, conf = F.when(test, f).otherwise(fmt), F.when(test, c).otherwise(conf)
    return fmt, conf


def package_format(data: bytes) -> str | None:
    """What a ZIP package is by its structure."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            kind = z.read("mimetype")[:64].decode("ascii", "replace") if "mimetype" in names else ""
    except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, KeyError, RuntimeError):
        return None
    found = [f for f, test in (("docx", any(n.startswith("word/document") for n in names)), ("pptx", "ppt/presentation.xml" in names), ("xlsx", "xl/workbook.xml" in names), ("epub", "META-INF/container.xml" in names and "epub" in kind), ("odf", kind.startswith("application/vnd.oasis.opendocument"))) if test]
    return found[0] if len(found) == 1 else "zip"


def text_format(s: str) -> tuple[str, float] | None:
    """What a text is by its content, in the order of the strongest evidence."""
    body = s.lstrip("﻿ \t\r\n")
    if body[:1] in ("{", "["):
        try:
            v = json.loads(body)
        except (ValueError, RecursionError):
            pass
        else:
            if isinstance(v, dict) and "nbformat" in v and "cells" in v:
                return "notebook", 0.99
            if isinstance(v, dict) and isinstance(v.get("parse"), dict) and "text" in v["parse"]:
                return "mediawiki", 0.99
            return "json", 0.96
    head = body
    if re.search(r"<(?:mxfile|mxGraphModel)[\s>]", head[:4096]):
        return "drawio", 0.99
    if re.match(r"(?:<\?xml[^>]*>\s*)?(?:<!--.*?-->\s*)*<(?:rss\b[^>]*version|feed\b[^>]*http://www.w3.org/2005/Atom)", head, re.S):
        return "feed", 0.99
    if re.match(r"(?i)<!doctype\s+html|<html[\s>]", head):
        return "html", 0.96
    if head.startswith("<?xml"):
        return "xml", 0.92
    if len(re.findall(r"(?i)<(?:p|div|table|ul|ol|h[1-6]|article|main|body|br|span|a)[\s>/]", head)) >= 2 and head[:1] == "<":
        return "html", 0.94
    if re.match(r"<[A-Za-z_][\w:.-]*(?:\s[^<>]*)?/?>", head) and head.rstrip().endswith(">"):
        return "xml", 0.92
    lines = head.split("\n")
    marks = sum(bool(re.match(r"\s{0,3}(?:#{1,6}\s|[-*+]\s|\d+[.)]\s|>\s?|```|~~~)", x)) for x in lines)
    if marks >= 2 or re.search(r"(?m)^\s*\|?\s*:?-{3,}:?\s*\|[\s|:-]*$", head) or re.search(r"(?m)^\s*[-*+] \[[ xX]\] ", head):
        return "markdown", 0.91
    from docloom.sources.text_formats import _records, has_header
    from docloom.plans.ir import ConversionError

    for sep, name in (("\t", "tsv"), (",", "csv")):
        try:
            rows = [r for r in _records(head, sep) if any(c.strip() for c in r)]
        except ConversionError:
            continue
        if len(rows) >= 3 and len({len(r) for r in rows}) == 1 and len(rows[0]) >= 2 and has_header(rows):
            return name, 0.90
    return None


def sniff_text(data: bytes) -> tuple[str, float] | None:
    """Plain text, and how surely: marked, UTF-8 or a legacy charset, with few unsafe characters."""
    from docloom.sources.text_formats import BOMS, sniff_legacy

    if not data:
        return "text", 0.80
    marked = next((name for bom, name in BOMS if data.startswith(bom)), None)
    try:
        s, conf = data.decode(marked or "utf-8"), 0.95 if marked else 0.88
    except UnicodeDecodeError:
        if marked:
            return "text", 0.80
        legacy = sniff_legacy(data)
        if not legacy:
            return None
        s, conf = data.decode(legacy), 0.72
    bad = len(re.findall(r"[\x00-\x08\x0e-\x1a\x1c-\x1f\x7f]", s))
    return None if bad or s.count("�") > len(s) / 100 else ("text", conf)


def content_evidence(docs: DataFrame) -> DataFrame:
    """Evidence of bytes: magic numbers as columns, packages and texts by one pass over the content."""
    from docloom.sources.compound import kind_of

    fmt, conf = magic(F.col("content"))
    known = docs.select("doc_id", fmt.alias("format"), conf.alias("confidence")).where("format is not null")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py() or b""
                if data.startswith(b"PK\x03\x04"):
                    kind = package_format(data)
                    out.append((i, kind or "zip", 0.90 if kind in (None, "zip") else 0.99))
                elif data.startswith(COMPOUND):
                    if kind := kind_of(data):
                        out.append((i, kind, 0.99))
                elif t := sniff_text(data):
                    out.append((i, *t))
                    s = data.decode("utf-8", "replace")
                    if f := text_format(s):
                        out.append((i, *f))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.float64())], ["doc_id", "format", "confidence"])

    seen = docs.where(fmt.isNull()).select("doc_id", "content").mapInArrow(look, "doc_id string, format string, confidence double")
    return known.unionByName(seen).select("doc_id", "format", "confidence", F.lit(200).alias("priority"), F.lit("content").alias("detector"), F.lit(False).alias("explicit"))


def merge_candidates(evidence: DataFrame) -> DataFrame:
    """The best evidence of each format, in the order in which candidates are tried."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl("confidence", F.lit(0.0))))
    x = evidence.withColumn("confidence", F.coalesce(sure, F.lit(0.0)))
    best = x.groupBy("doc_id", "format").agg(F.bool_or("explicit").alias("explicit"), F.max_by(F.struct("confidence", "priority", "detector"), F.struct("confidence", "priority")).alias("b"))
    best = best.select("doc_id", "format", "explicit", "b.confidence", "b.priority", "b.detector")
    order = W.partitionBy("doc_id").orderBy(F.desc("explicit"), F.desc("confidence"), F.desc("priority"), "detector", "format")
    return best.withColumn("rank", F.row_number().over(order))


def converter_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONVERTERS), "converter_id string, converter_priority int, formats array<string>")


def choose_converters(candidates: DataFrame) -> DataFrame:
    """The first candidate with a converter: (doc_id, format, converter_id, score)."""
    c = F.broadcast(converter_table(candidates.sparkSession))  # a fixed table
    x = candidates.join(c, F.array_contains("formats", F.col("format"))).withColumn("score", F.col("confidence"))
    order = W.partitionBy("doc_id").orderBy(F.desc("explicit"), F.desc("score"), F.desc("converter_priority"), "converter_id", "format")
    return x.withColumn("n", F.row_number().over(order)).where("n = 1").select("doc_id", "format", "converter_id", "score")
