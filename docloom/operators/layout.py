"""Page layout from positioned glyphs or recognised regions.

A page is a group of bounded size, so its algorithms run per page in pandas;
everything between pages is a join or an aggregation.
"""

from __future__ import annotations

import re
import statistics

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_CONFIDENCE = 0.70
MAX_CUTS = 24
_LINE = "doc_id string, page int, line int, x double, y double, w double, h double, size double, text string"
_MARKER = re.compile(r"^(?:[•‣▪◦*-]|\(?(?:\d{1,3}|[a-zA-Z])[.)])\s+")


def cluster_lines(glyphs: DataFrame) -> DataFrame:
    """Glyphs (doc_id, page, x, y, w, h, size, text; y downwards) to lines.

    Glyphs of one line share half their height; a gap of more than three sizes
    starts another line, one of more than a fifth of the size is a space.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, groups = [], []
        for g in pdf.sort_values(["y", "x"]).itertuples():
            best = next((k for k in reversed(groups[-6:]) if min(k[-1].y + k[-1].h, g.y + g.h) - max(k[-1].y, g.y) >= 0.5 * min(k[-1].h, g.h)), None)
            if best is None:
                groups.append([g])
            else:
                best.append(g)
        for k in groups:
            k.sort(key=lambda g: g.x)
            part = [k[0]]
            for g in k[1:] + [None]:
                if g is None or g.x - (part[-1].x + part[-1].w) > 3 * max(part[-1].size, 1.0):
                    s = part[0].text
                    for a, b in zip(part, part[1:], strict=False):
                        s += (" " if b.x - (a.x + a.w) > 0.2 * max(a.size, 1.0) else "") + b.text
                    x, y = min(p.x for p in part), min(p.y for p in part)
                    rows.append((part[0].doc_id, part[0].page, len(rows), x, y, max(p.x + p.w for p in part) - x, max(p.y + p.h for p in part) - y, statistics.median(p.size for p in part), " ".join(s.split())))
                    part = [g]
                else:
                    part.append(g)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _LINE.split(", ")])

    return glyphs.groupBy("doc_id", "page").applyInPandas(run, _LINE)


def reading_order(boxes: DataFrame, gutter: float = 0.02) -> DataFrame:
    """XY-cut: boxes (doc_id, page, box, x, y, w, h) with `position` in reading order.

    The widest gap that no box crosses divides a region: columns left to
    right, bands top to bottom; what cannot be divided is read by lines.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[int] = []
        width = float((pdf["x"] + pdf["w"]).max() - pdf["x"].min()) or 1.0

        def gaps(items: list, lo: str, size: str) -> list[tuple[float, float]]:
            found, end = [], None
            for b in sorted(items, key=lambda b: getattr(b, lo)):
                s, e = getattr(b, lo), getattr(b, lo) + getattr(b, size)
                if end is not None and s > end:
                    found.append((s - end, (s + end) / 2))
                end = e if end is None else max(end, e)
            return found

        def cut(items: list, depth: int) -> None:
            if len(items) > 1 and depth < MAX_CUTS:
                across = [g for g in gaps(items, "x", "w") if g[0] >= gutter * width]
                down = gaps(items, "y", "h")
                if across:
                    at = max(across)[1]
                    left = [b for b in items if b.x + b.w <= at]
                    cut(left, depth + 1)
                    cut([b for b in items if b.x + b.w > at], depth + 1)
                    return
                if down:
                    at = max(down, key=lambda g: (g[0], -g[1]))[1]
                    cut([b for b in items if b.y + b.h <= at], depth + 1)
                    cut([b for b in items if b.y + b.h > at], depth + 1)
                    return
            out.extend(b.Index for b in sorted(items, key=lambda b: (b.y, b.x)))

        cut(list(pdf.itertuples()), 0)
        place = {i: n for n, i in enumerate(out)}
        return pdf.assign(position=[place[i] for i in pdf.index])[["doc_id", "page", "box", "position"]]

    return boxes.groupBy("doc_id", "page").applyInPandas(run, "doc_id string, page int, box int, position int")


def classify_lines(lines: DataFrame) -> DataFrame:
    """Adds `kind` (heading, list, text) and `level` by font size, length and marker."""
    from docloom.functions.markdown import heading_level

    medians = lines.groupBy("doc_id").agg(F.expr("percentile(size, 0.5)").alias("median"))
    x = lines.join(medians, "doc_id").withColumn("level", F.when(F.length("text") <= 160, heading_level(F.col("size"), F.col("median"))))
    kind = F.when(F.col("level").isNotNull(), "heading").when(F.col("text").rlike(_MARKER.pattern), "list").otherwise("text")
    return x.withColumn("kind", kind).drop("median")


def paragraphs_of_lines(lines: DataFrame, spacing: float = 1.8) -> DataFrame:
    """Joins lines (doc_id, page, line, x, y, w, h, text) that follow within `spacing` heights into paragraphs."""
    from pyspark.sql import Window as W

    from docloom.operators.analysis import islands

    w = W.partitionBy("doc_id", "page").orderBy("y", "x")
    far = F.coalesce(F.col("y") - F.lag("y").over(w) > spacing * F.lag("h").over(w), F.lit(True))
    x = islands(lines.withColumn("_f", far), ["doc_id", "page"], ["y", "x"], F.col("_f"), "paragraph")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "text"))), lambda s: s["text"]), " ")
    return x.groupBy("doc_id", "page", "paragraph").agg(joined.alias("text"), F.min("y").alias("y"))


def merge_ocr(detected: DataFrame, recognised: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """Regions with their text by source_index, where both confidences reach `least`."""
    x = detected.join(recognised, ["doc_id", "page", "source_index"])
    return x.where((F.col("det_conf") >= least) & (F.col("rec_conf") >= least) & (F.trim("text") != ""))


def drop_known(ocr: DataFrame, native: DataFrame, least: float = 0.55, cell: float = 100.0) -> DataFrame:
    """OCR regions that no native region of the same text covers by `least`: a range join by cells, then an anti join."""
    key = lambda: F.lower(F.regexp_replace("text", r"\s+", ""))
    deal = lambda d: d.withColumn("k", key()).withColumn("cell", F.explode(F.sequence(F.floor(F.col("x") / cell), F.floor((F.col("x") + F.col("w")) / cell))))
    a, b = deal(ocr).alias("a"), deal(native).alias("b")
    hit = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("doc_id", "page", "cell", "k")])
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(F.col(f"a.{p}") + F.col(f"a.{s}"), F.col(f"b.{p}") + F.col(f"b.{s}")) - F.greatest(f"a.{p}", f"b.{p}"))
    seen = hit.where(side("x", "w") * side("y", "h") >= least * F.col("a.w") * F.col("a.h")).select(F.col("a.doc_id").alias("doc_id"), F.col("a.page").alias("page"), F.col("a.region_id").alias("region_id")).distinct()
    return ocr.join(seen, ["doc_id", "page", "region_id"], "left_anti")


def wants_ocr(pages: DataFrame, mode: str = "auto", chars: int = 8, coverage: float = 0.5) -> DataFrame:
    """Adds `ocr`: off, always, or where a page has few characters of its own and is mostly image."""
    test = {"off": F.lit(False), "always": F.lit(True)}.get(mode, (F.col("native_chars") < chars) & (F.col("image_coverage") >= coverage))
    return pages.withColumn("ocr", test)
