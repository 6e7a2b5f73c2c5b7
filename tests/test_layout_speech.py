"""Page layout, transcripts, URLs and dates on small cases."""

import math

from pyspark.sql import functions as F

from docloom.functions import web
from docloom.operators import layout, speech

BOX = "doc_id string, page int, box int, x double, y double, w double, h double"


def test_two_columns_are_read_one_after_the_other(spark):
    rows = [("d", 1, 0, 0, 0, 200, 10), ("d", 1, 1, 110, 20, 90, 10), ("d", 1, 2, 0, 20, 90, 10), ("d", 1, 3, 0, 40, 90, 10), ("d", 1, 4, 110, 40, 90, 10), ("d", 2, 0, 5, 5, 5, 5)]
    boxes = spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], BOX)
    got = layout.reading_order(boxes).where("page = 1").orderBy("position").collect()
    assert [r["box"] for r in got] == [0, 2, 3, 1, 4]


def test_glyphs_become_lines_kinds_and_paragraphs(spark):
    def word(s, x, y, size):
        return [("d", 1, float(x + i * size / 2), float(y), size / 2, size, size, c) for i, c in enumerate(s)]

    glyphs = word("Title", 0, 0, 24.0) + word("one", 0, 40, 10.0) + word("two", 20, 41, 10.0) + word("far", 200, 40, 10.0) + word("1.", 0, 52, 10.0) + word("item", 14, 52, 10.0) + word("end", 0, 200, 10.0)
    lines = layout.cluster_lines(spark.createDataFrame(glyphs, "doc_id string, page int, x double, y double, w double, h double, size double, text string"))
    got = {r["text"]: (r["kind"], r["level"]) for r in layout.classify_lines(lines).collect()}
    assert got == {"Title": ("heading", 1), "one two": ("text", None), "far": ("text", None), "1. item": ("list", None), "end": ("text", None)}
    assert {"end"} < {r["text"] for r in layout.paragraphs_of_lines(lines).collect()}


def test_ocr_is_filtered_and_known_text_dropped(spark):
    det = spark.createDataFrame([("d", 1, 0, 0.9), ("d", 1, 1, 0.5)], "doc_id string, page int, source_index int, det_conf double")
    rec = spark.createDataFrame([("d", 1, 0, 0.9, "a"), ("d", 1, 1, 0.9, "b")], "doc_id string, page int, source_index int, rec_conf double, text string")
    assert [r["text"] for r in layout.merge_ocr(det, rec).collect()] == ["a"]
    reg = "doc_id string, page int, region_id int, x double, y double, w double, h double, text string"
    ocr = spark.createDataFrame([("d", 1, 0, 95.0, 0.0, 20.0, 10.0, "Same Text"), ("d", 1, 1, 300.0, 0.0, 20.0, 10.0, "other")], reg)
    native = spark.createDataFrame([("d", 1, 0, 96.0, 1.0, 20.0, 10.0, "same text"), ("d", 1, 1, 300.0, 0.0, 20.0, 10.0, "x")], reg)
    assert [r["region_id"] for r in layout.drop_known(ocr, native).collect()] == [1]
    pages = spark.createDataFrame([(1, 3, 0.9), (2, 30, 0.9), (3, 3, 0.1)], "page int, native_chars int, image_coverage double")
    assert [r["page"] for r in layout.wants_ocr(pages).where("ocr").collect()] == [1]
    assert layout.wants_ocr(pages, "always").where("ocr").count() == 3


def test_windows_speakers_and_order(spark):
    rows = [(1, 0, 0, 1000, 100, "a"), (1, 0, 0, 1000, 900, "late"), (1, 1, 800, 1800, 850, "early"), (1, 1, 800, 1800, 950, "b")]
    tokens = spark.createDataFrame(rows, "rec_id long, window int, win_start long, win_end long, at_ms long, text string")
    assert sorted(r["text"] for r in speech.own_tokens(tokens).collect()) == ["a", "b"]
    segs = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 5, 4), (1, 2, 1, 9)], "rec_id long, seq int, start_ms long, end_ms long")
    assert sorted(r["seq"] for r in speech.out_of_order(segs).collect()) == [1, 2]
    conf = spark.createDataFrame([(1, 0, 0.5), (1, 0, 2.0), (1, 0, float("nan"))], "rec_id long, seg int, confidence double")
    assert speech.segment_confidence(conf).first()["confidence"] == 0.75
    vec = [(1, i, [math.cos(a), math.sin(a), 0.0]) for i, a in enumerate((0.0, 0.1, 1.6, 0.05, 1.5))]
    who = speech.diarize(spark.createDataFrame(vec, "rec_id long, seq int, embedding array<double>"))
    assert [r["speaker"] for r in who.orderBy("seq").collect()] == [1, 1, 2, 1, 2]
    named = speech.label_speakers(who, spark.createDataFrame([(1, 2, "Ann")], "rec_id long, speaker int, label string"))
    assert {r["label"] for r in named.collect()} == {"Speaker 1", "Ann"}


def test_urls_and_dates(spark):
    urls = [("https://e.org/a", True), ("http://e.org/?q", False), ("http://u@e.org/", False), ("http://10.1.2.3/", False), ("ftp://e.org/", False), ("no url", False), (None, False), ("http://localhost/", False)]
    got = spark.createDataFrame(urls, "u string, want boolean").select(web.is_http_base(F.col("u")).alias("b"), "want").collect()
    assert all(r["b"] == r["want"] for r in got)
    dates = ["2024-01-02T03:04:05Z", "Tue, 02 Jan 2024 03:04:05 GMT", "2 Jan 2024 05:04:05 +0200", "never"]
    out = [r["t"] for r in spark.createDataFrame([(d,) for d in dates], "d string").select(F.date_format(web.to_utc(F.col("d")), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()]
    assert out == ["2024-01-02 03:04:05"] * 3 + [None]
