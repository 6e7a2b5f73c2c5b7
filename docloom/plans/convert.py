"""The conversion pipeline: bytes -> detected -> converted -> rendered -> classified."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import detect
from docloom.plans import ir
from docloom.plans.ir import ConversionError, Document
from docloom.session import small_batches
from docloom.sources import compound, html, packages, text_formats

Parser = Callable[..., Document]
PARSERS: dict[str, Parser] = {
    "text": text_formats.text_document, "csv": lambda d, **o: text_formats.delimited_document(d, ",", **o), "tsv": lambda d, **o: text_formats.delimited_document(d, "\t", **o),
    "json": text_formats.json_document, "xml": text_formats.xml_document, "markdown": text_formats.markdown_document, "html": html.html_document, "feed": text_formats.feed_document,
    "notebook": text_formats.notebook_document, "mediawiki": text_formats.mediawiki_document, "drawio": text_formats.drawio_document, "rtf": text_formats.rtf_document,
    "docx": packages.docx_document, "pptx": packages.pptx_document, "xlsx": packages.xlsx_document, "odf": packages.odf_document, "epub": packages.epub_document, "image": packages.image_document,
    "doc": compound.doc_document, "xls": compound.xls_document, "ppt": compound.ppt_document, "msg": compound.msg_document,
}
MAX_NESTED = 4


def register(fmt: str, parser: Parser) -> None:
    """Adds a parser; a format that has one already is refused."""
    if fmt in PARSERS:
        raise ValueError(f"a parser of {fmt} is there already")
    PARSERS[fmt] = parser


def guess(name: str | None, data: bytes) -> str | None:
    """The format of bytes without a DataFrame, for members of archives."""
    if data.startswith(b"PK\x03\x04"):
        return detect.package_format(data)
    if data.startswith(b"{\\rtf"):
        return "rtf"
    if packages.image_size(data):
        return "image"
    if data.startswith(detect.COMPOUND):
        return compound.kind_of(data)
    by_name = next((f for f, es in detect.EXTENSIONS.items() if (name or "").rpartition(".")[2].lower() in es.split()), None)
    if by_name in ("markdown", "csv", "tsv") and detect.sniff_text(data):
        return by_name
    if not detect.sniff_text(data):
        return None
    found = detect.text_format(data.decode("utf-8", "replace"))
    return found[0] if found else "text"


def parse(fmt: str, data: bytes, name: str | None = None, depth: int = 0, **options) -> Document:
    if fmt == "zip":
        if depth >= MAX_NESTED:
            raise ConversionError("resourceLimit", limit="max_nesting_depth")
        doc = Document()
        for member, content in packages.zip_members(data):
            inner = guess(member, content)
            doc.blocks.append(ir.heading(2, ir.text(member)))
            if inner is None or (inner not in PARSERS and inner != "zip"):
                doc.diagnostics.append(("zip.memberSkipped", "warning", member))
                continue
            try:
                part = parse(inner, content, member, depth + 1, **options)
            except ConversionError as e:
                doc.diagnostics.append(("zip.memberFailed", "warning", f"{member}: {e.code}"))
                continue
            doc.blocks += part.blocks
            doc.diagnostics += part.diagnostics
            doc.assets += part.assets
        return doc
    if fmt not in PARSERS:
        raise ConversionError("unsupportedFormat")
    return PARSERS[fmt](data, name=name, **options) if fmt == "image" else PARSERS[fmt](data, **options)


RESULT = "doc_id string, format string, converter_id string, title string, markdown string, error_code string, limit_name string, diagnostics array<struct<code:string,severity:string,message:string>>, assets array<struct<filename:string,media_type:string,sha256:string,size:long,content:binary>>, nodes int, input_sha256 string"


def convert(docs: DataFrame, max_input_bytes: int = 64 << 20, **options) -> DataFrame:
    """doc_id, source_name, media_type, content -> one result row each.

    Documents that no converter takes, and those that break their format's
    rules, give a row with an error code; none ever fails the job.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source_name", "media_type", "content")
    # Evidence is of what a row holds, not of its id: ids may be repeated or missing.
    row = F.concat_ws(":", F.hex(F.xxhash64("doc_id", "source_name", "media_type", "content")), F.hex(F.hash("content", "doc_id", "source_name")))
    docs = docs.withColumn("row", row)
    seen = docs.select(F.col("row").alias("doc_id"), "source_name", "media_type", "content")
    evidence = detect.hint_evidence(seen).unionByName(detect.content_evidence(seen))
    chosen = detect.choose_converters(detect.merge_candidates(evidence)).select(F.col("doc_id").alias("row"), "format", "converter_id")
    return convert_as(docs.join(chosen, "row", "left"), max_input_bytes, **options)


def convert_as(docs: DataFrame, max_input_bytes: int = 64 << 20, **options) -> DataFrame:
    """doc_id, source_name, content, format, converter_id -> results, with the format given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.string()), ("format", pa.string()), ("converter_id", pa.string()), ("title", pa.string()), ("markdown", pa.string()), ("error_code", pa.string()), ("limit_name", pa.string()), ("diagnostics", pa.list_(pa.struct([("code", pa.string()), ("severity", pa.string()), ("message", pa.string())]))), ("assets", pa.list_(pa.struct([("filename", pa.string()), ("media_type", pa.string()), ("sha256", pa.string()), ("size", pa.int64()), ("content", pa.binary())]))), ("nodes", pa.int32()), ("input_sha256", pa.string())])
        for batch in batches:
            out = []
            for i, name, data, fmt, converter in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                row = {"doc_id": i, "format": fmt, "converter_id": converter, "title": None, "markdown": None, "error_code": None, "limit_name": None, "diagnostics": [], "assets": [], "nodes": 0, "input_sha256": hashlib.sha256(data or b"").hexdigest()}
                try:
                    if data is not None and len(data) > max_input_bytes:
                        raise ConversionError("resourceLimit", limit="max_input_bytes")
                    if fmt is None:
                        raise ConversionError("unsupportedFormat")
                    doc = parse(fmt, data or b"", name, **options)
                    if wrong := ir.validate(doc):
                        raise ConversionError("invalidDocument", ",".join(wrong))
                    md = doc.properties.get("verbatim") if fmt == "markdown" else ir.render(doc)
                    row |= {"title": doc.title, "markdown": md, "diagnostics": [dict(zip(("code", "severity", "message"), d, strict=True)) for d in doc.diagnostics], "assets": doc.assets, "nodes": len(ir.nodes(doc))}
                except ConversionError as e:
                    row |= {"error_code": e.code, "limit_name": e.limit}
                except Exception:  # whatever a broken file leads a parser to, the job goes on
                    row |= {"error_code": "malformed"}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)

    small_batches(docs.sparkSession, 128)
    return docs.select("doc_id", "source_name", "content", "format", "converter_id").mapInArrow(run, RESULT)


def node_table(docs: DataFrame, fmt: str) -> DataFrame:
    """doc_id, content -> rows of the node table, of one format."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(i, *n) for n in ir.nodes(parse(fmt, data or b""))]
                except ConversionError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "node_id", "parent_id", "path", "depth", "kind", "level", "name", "text"])

    return docs.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, "doc_id string, " + ir.NODE_SCHEMA)


def classify(results: DataFrame) -> DataFrame:
    """Adds `outcome` and `content_class` to results."""
    from docloom.functions.markdown import has_visible

    visible, assets = has_visible(F.col("markdown")), F.size("assets") > 0
    worse = F.exists("diagnostics", lambda d: d["severity"] != "info")
    kind = F.when(F.col("error_code").isNotNull(), None).when(visible, "visible").when(assets, "assetsOnly").otherwise("empty")
    outcome = F.when(F.col("error_code").isNotNull(), "failed").when(~visible & ~assets, "empty").when(worse, "degraded").otherwise("complete")
    return results.withColumns({"outcome": outcome, "content_class": kind})


def report(results: DataFrame) -> DataFrame:
    """Counts by format and outcome, with subtotals."""
    return results.rollup("format", "outcome").agg(F.count("*").alias("items"), F.sum(F.size("assets")).alias("assets"), F.sum(F.length("markdown")).alias("chars"))
