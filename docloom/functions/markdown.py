"""Column functions for Markdown and for the identity of documents; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_lf(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n|\r", "\n")


def single_line(c: Column) -> Column:
    return F.replace(normalize_lf(c), F.lit("\n"), F.lit(" "))


def collapse(c: Column) -> Column:
    """Runs of Unicode white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def escape_run(c: Column) -> Column:
    """Markdown's special characters escaped; an underscore within a word stays."""
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.regexp_replace(c, r"(?U)([\\`*\[\]<~]|(?<![\p{Alnum}])_|_(?![\p{Alnum}]))", r"\\$1")


def protect_lines(c: Column) -> Column:
    """Block markers at the start of lines escaped, and deep indents kept."""
    c = F.regexp_replace(c, r"(?m)^\t", "&#9;")
    c = F.regexp_replace(c, r"(?m)^ {4}", "&#32;   ")
    c = F.regexp_replace(c, r"(?m)^( {0,3})(>|#{1,6}(?=\s|$)|[+-](?=\s|$)|=+\s*$|-+\s*$)", r"$1\\$2")
    return F.regexp_replace(c, r"(?m)^( {0,3}\d{1,9})([.)])(?=\s|$)", r"$1\\$2")


def escape_html(c: Column, quotes: bool = False) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#39;")) if quotes else ())):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def longest_run(c: Column, ch: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(f"({ch}+)"), F.lit(1)), F.length)), F.lit(0))


def code_span(c: Column) -> Column:
    c = single_line(c)
    fence = F.repeat(F.lit("`"), longest_run(c, "`") + 1)
    pad = F.when(c.startswith("`") | c.endswith("`") | (c.startswith(" ") & c.endswith(" ")), F.lit(" ")).otherwise("")
    return F.when(F.trim(c) == "", F.concat(F.lit("<code>"), c, F.lit("</code>"))).otherwise(F.concat(fence, pad, c, pad, fence))


def fence(c: Column, language: Column | str = "") -> Column:
    c = normalize_lf(c)
    marks = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_run(c, "`") + 1))
    language = F.lit(language) if isinstance(language, str) else language
    return F.concat(marks, language, F.lit("\n"), c, F.when(c.endswith("\n") | (c == ""), "").otherwise("\n"), marks)


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |"))


def footnote_label(c: Column) -> Column:
    return F.concat(F.lit("fn-"), F.lower(F.hex(F.encode(c, "UTF-8"))))


def clock(ms: Column) -> Column:
    """HH:MM:SS.mmm of milliseconds."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)


def asset_name(sha256: Column, media_type: Column) -> Column:
    kinds = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg", "text/plain": "txt", "text/html": "html"}
    ext = F.lit("bin")
    for mime, e in kinds.items():
        ext = F.when(media_type == mime, e).otherwise(ext)
    return F.concat(F.lit("asset-"), sha256, F.lit("."), ext)


def data_uri(content: Column, media_type: Column) -> Column:
    return F.concat(F.lit("data:"), media_type, F.lit(";base64,"), F.base64(content))


def has_visible(c: Column) -> Column:
    """Whether anything but white space and byte order marks is there."""
    return F.coalesce(c, F.lit("")).rlike(r"(?U)[^\s\x{FEFF}]")


def is_number(c: Column) -> Column:
    return F.trim(c).rlike(r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$")


def cell_name(row: Column, col: Column) -> Column:
    """Spreadsheet name of a cell from zero-based numbers, up to three letters."""
    a, b, c = col, F.floor(col / 26) - 1, F.floor((F.floor(col / 26) - 1) / 26) - 1
    letter = lambda x: F.when(x >= 0, F.char((x % 26 + 65).cast("long"))).otherwise("")
    return F.concat(letter(c), letter(b), letter(a), (row + 1).cast("string"))


def is_safe_link(c: Column) -> Column:
    return (c != "") & ~c.contains("&") & ~c.rlike(r"[\x00-\x20]") & ~c.rlike("(?i)^(javascript|data|vbscript|file):")


def heading_level(size: Column, median: Column) -> Column:
    """Level by the ratio of a font size to the page's median; null below all."""
    r = size / median
    return F.when(r >= 2.0, 1).when(r >= 1.65, 2).when(r >= 1.4, 3).when(r >= 1.25, 4)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def safety_ratios(c: Column) -> tuple[Column, Column]:
    """Shares of replacement characters and of printable characters."""
    n = F.greatest(F.length(c), F.lit(1))
    return F.regexp_count(c, F.lit("�")) / n, 1 - F.regexp_count(c, F.lit(r"[\x00-\x08\x0E-\x1F\x7F]")) / n
