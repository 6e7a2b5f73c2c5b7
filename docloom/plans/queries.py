"""The library's own queries over the test tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import markdown as md
from docloom.functions import web
from docloom.operators import analysis, detect, layout, speech
from docloom.plans import convert as plan
from docloom.session import spread, table
from docloom.sources.readers import from_text
from docloom.streaming.pipeline import event_windows


def convert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML to Markdown, detected, converted and classified."""
    docs = from_text(spread(table(spark, sf_dir, "pages")), "page_id", "html", "html", "text/html")
    r = plan.classify(plan.convert(docs))
    return r.select(F.col("doc_id").cast("long").alias("page_id"), "format", "converter_id", "title", "markdown", "outcome", "content_class", "error_code", "nodes")


def convert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text to Markdown through detection."""
    docs = from_text(spread(table(spark, sf_dir, "documents")), "doc_id", "text", "txt", "text/plain")
    r = plan.classify(plan.convert(docs))
    return r.select(F.col("doc_id").cast("long").alias("doc_id"), "format", "converter_id", F.length("markdown").alias("markdown_chars"), "outcome", "error_code", "input_sha256")


def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by kind of every page."""
    docs = spread(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), F.encode("html", "UTF-8").alias("content"))
    return plan.node_table(docs, "html").groupBy(F.col("doc_id").cast("long").alias("page_id"), "kind").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


def text_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split(md.normalize_lf(F.col("text")), "\n")).alias("line", "text"))
    return analysis.paragraphs(lines, ["doc_id"], "line", "text")


def text_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text converter by columns alone: lines become breaks, markers are escaped."""
    d = table(spark, sf_dir, "documents")
    escaped = md.escape_run(md.normalize_lf(F.col("text")))
    return d.select("doc_id", F.concat(F.replace(escaped, F.lit("\n"), F.lit("  \n")), F.lit("\n")).alias("markdown"))


def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", md.escape_html(F.col("html"), quotes=True).alias("escaped"))


def html_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    take = lambda r: F.regexp_extract("html", r, 1)
    return p.select("page_id", take("<title>([^<]*)</title>").alias("title"), take('<html lang="([^"]*)"').alias("lang"), take('charset="([^"]*)"').alias("charset"))


def safe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.sum(md.is_safe_link(F.col("href")).cast("long")).alias("safe"))


def delimited_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", md.table_row(F.col("n_nationkey"), F.replace("n_name", F.lit("|"), F.lit("\\|")), F.col("n_regionkey")).alias("row"))


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("`k`: "), md.code_span(F.get_json_object("props", "$.k"))).alias("line"))


def media_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", md.clock(F.col("event_id") * 1234567 % F.lit(360_000_000)).alias("clock"))


def cell_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", md.cell_name(F.col("o_orderkey"), F.col("o_orderkey") % 16_384).alias("cell"))


def footnote_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", md.footnote_label(F.col("n_name")).alias("label"))


def text_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad, _ = md.safety_ratios(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.is_valid_utf8(F.col("text")).alias("valid"), md.has_visible(F.col("text")).alias("visible"), F.round(bad, 6).alias("replaced"))


def format_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from names and media types, merged and ranked."""
    exts = F.array(*[F.lit(x) for x in ("txt", "md", "html", "json", "csv", "rar", "bin", "docx")])
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("f."), F.element_at(exts, (F.col("o_orderkey") % 8 + 1).cast("int"))).alias("source_name"), F.when(F.col("o_orderkey") % 3 == 0, "text/html").alias("media_type"))
    c = detect.merge_candidates(detect.hint_evidence(docs))
    return c.where("rank = 1").select("doc_id", "format", "confidence")


def converter_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    exts = F.array(*[F.lit(x) for x in ("txt", "md", "html", "json", "csv", "pdf")])
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("f."), F.element_at(exts, (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("source_name"), F.lit(None).cast("string").alias("media_type"))
    return detect.choose_converters(detect.merge_candidates(detect.hint_evidence(docs))).select("doc_id", "format", "converter_id", "score")


def resource_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("max_input_bytes"), F.size(F.split("text", "\n")).alias("max_lines"))
    return analysis.limit_errors(d, {"max_input_bytes": 8000, "max_lines": 10})


def running_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as its pages: first and last lines that come back."""
    d = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    edge = F.array(F.struct(F.lit(0.0).alias("top"), F.element_at(lines, 1).alias("text")), F.struct(F.lit(1.0).alias("top"), F.element_at(lines, -1).alias("text")))
    x = d.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.explode(edge).alias("e")).select("doc_id", "page", "e.top", "e.text")
    return analysis.running_matter(x)


def feed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return analysis.first_of_key(d, analysis.feed_key(F.lit(None), F.lit(None), F.col("text")), "doc_id").select("doc_id", "source")


def asset_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("asset_id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.lit("text/plain").alias("media_type"))
    return analysis.plan_assets(d).select("sha256", "first", "uses", "conflict", md.asset_name(F.col("sha256"), F.col("media_type")).alias("filename"))


def list_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", F.concat(n.cast("string"), F.lit(". "), F.col("role")).alias("item"))


def speaker_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as segments: neighbours of one type and near in time become one."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), (F.col("event_id") * 700).alias("start_ms"), (F.col("event_id") * 700 + 400).alias("end_ms"), F.col("event_type").alias("speaker"), F.col("event_id").cast("string").alias("text"))
    return analysis.merge_same_speaker(e, gap_ms=150_000)


def token_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as tokens in time, orders as turns."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("rec_id"), F.col("o_orderkey").alias("turn"), (F.col("o_orderkey") * 1000).alias("start_ms"), (F.col("o_orderkey") * 1000 + 700).alias("end_ms"))
    t = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("rec_id"), F.col("l_linenumber").alias("token"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 150).alias("at_ms"))
    return analysis.tokens_to_turns(t, o).groupBy("turn").agg(F.count("*").alias("tokens"), F.max("at_ms").alias("last"))


def region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as boxes on pages of text."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select((k % 20).alias("page_id"), k.alias("region_id"), (k * 37 % 900).cast("double").alias("x"), (k * 11 % 40).cast("double").alias("y"), F.lit(120.0).alias("w"), F.lit(20.0).alias("h"), (k % 3).cast("string").alias("text"))
    return analysis.overlapping_regions(p).select("page_id", "kept", "dropped", F.round("overlap", 6).alias("overlap"))


def quality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of (language, source) pairs of labelled documents against all."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    some = d.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    return analysis.precision_recall(d, some, ["lang", "source"], ["lang"])


def node_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders against a copy of which every fifth has another id and every seventh another value."""
    k = F.col("o_orderkey")
    a = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("value"))
    b = table(spark, sf_dir, "orders").select(F.when(k % 5 == 0, -k - 1).otherwise(k).alias("id"), F.when(F.col("o_orderkey") % 7 == 0, "?").otherwise(F.col("o_orderstatus")).alias("value"))
    return analysis.node_diff(a, b, ["id"], "value")


def orphan_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(labels, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("unlabelled"))


def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("outcome", F.when(F.col("n_chars") > 3000, "degraded").otherwise("complete"))
    r = plan.report(d.select(F.col("lang").alias("format"), "outcome", F.array().cast("array<string>").alias("assets"), F.col("text").alias("markdown")))
    return r.select(F.col("format").alias("lang"), "outcome", "items", "chars")


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return analysis.keyset_page(o, "day", "o_orderkey", 100, ("1997-06-01", 0))


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("out/"), F.lower("c_mktsegment"), F.lit(".md")).alias("target"))
    return analysis.disambiguate(p, "target", "c_custkey")


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as font sizes on pages of one brand."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("page"), "p_partkey", F.col("p_size").cast("double").alias("size"))
    medians = p.groupBy("page").agg(F.expr("percentile(size, 0.5)").alias("median"))
    return p.join(medians, "page").select("page", "p_partkey", F.coalesce(md.heading_level(F.col("size"), F.col("median")), F.lit(0)).alias("level"))


def ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers below nations below regions."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return analysis.ancestry(n.unionByName(c))


def robust_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = analysis.robust_mean(table(spark, sf_dir, "events"), ["event_type"], "value")
    return r.select("event_type", F.round("robust", 6).alias("robust"))


def patched_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("node_id"), F.col("n_name").alias("text"))
    patch = n.where("node_id % 4 = 0").withColumn("text", F.lower("text")).unionByName(n.where("node_id = 1").withColumn("node_id", F.lit(1000).cast(n.schema["node_id"].dataType)))
    return analysis.apply_patch(n, patch)


def cluster_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    dim = F.size("embedding")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centroids = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    r = analysis.cluster_margin(e.where(dim > 0).select("vec_id", F.col("embedding").cast("array<double>").alias("v")), centroids)
    return r.select("vec_id", F.round("similarity", 4).alias("similarity"), F.round("margin", 4).alias("margin"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = event_windows(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return r.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as segments of twenty recordings."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 20).alias("rec_id"), F.col("vec_id").cast("int").alias("seq"), "embedding")
    return speech.diarize(e).select("rec_id", "seq", "speaker", "reliable")


def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as boxes of two columns, twenty to a page."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.lit("d").alias("doc_id"), F.floor(k / 20).cast("int").alias("page"), k.cast("int").alias("box"), (k % 2 * 110).cast("double").alias("x"), (F.floor(k % 20 / 2) * 20).cast("double").alias("y"), F.lit(100.0).alias("w"), F.lit(12.0).alias("h"))
    return layout.reading_order(p).select("page", "box", "position")


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as tokens heard in windows of 1,000 every 800."""
    t = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("rec_id"), (F.col("l_orderkey") % 7).cast("int").alias("window"), (F.col("l_linenumber") * 100 + F.col("l_orderkey") % 97).alias("add"), F.col("l_orderkey"))
    t = t.select("rec_id", "window", (F.col("window") * 800).alias("win_start"), (F.col("window") * 800 + 1000).alias("win_end"), (F.col("window") * 800 + F.col("add")).alias("at_ms"))
    return speech.own_tokens(t).groupBy("rec_id", "window").agg(F.count("*").alias("tokens"), F.min("at_ms").alias("first"), F.max("at_ms").alias("last"))


def http_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.is_http_base(F.col("url")).alias("base"))


def feed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as RFC 822, read back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss").alias("d"))
    return o.select("o_orderkey", F.date_format(web.to_utc(F.concat(F.col("d"), F.lit(" GMT"))), "yyyy-MM-dd").alias("day"))


def paragraph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as lines of a page, a wide gap before every fourth."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    y = F.col("line") * 12 + F.floor(F.col("line") / 4) * 20
    x = d.select("doc_id", F.lit(1).alias("page"), "line", F.lit(0.0).alias("x"), y.cast("double").alias("y"), F.lit(100.0).alias("w"), F.lit(10.0).alias("h"), "text")
    return layout.paragraphs_of_lines(x).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max(F.length("text")).alias("longest"))


QUERIES = {f.__name__: f for f in (convert_pages, convert_documents, html_nodes, text_paragraphs, text_markdown, html_escape, html_metadata, safe_links, delimited_table, json_lines, media_clock, cell_names, footnote_labels, text_safety, format_hints, converter_choice, resource_limits, running_matter, feed_dedup, asset_plan, list_numbering, speaker_merge, token_turns, region_overlap, quality_audit, node_differences, orphan_references, batch_report, keyset_page, output_names, heading_levels, ancestry, robust_values, patched_nodes, cluster_assignment, daily_events, speakers, page_order, token_windows, http_bases, feed_dates, paragraph_lines)}

ORACLES = {
    "page_order": "SELECT (p_partkey // 20)::INTEGER AS page, p_partkey::INTEGER AS box, (row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey % 2, p_partkey) - 1)::INTEGER AS position FROM part",
    "token_windows": """WITH t AS (SELECT l_orderkey % 10 AS rec_id, (l_orderkey % 7)::INTEGER AS w, (l_orderkey % 7) * 800 + l_linenumber * 100 + l_orderkey % 97 AS at_ms FROM lineitem),
        s AS (SELECT rec_id, w, coalesce((w * 800 + lag(w * 800 + 1000) OVER o) / 2.0, w * 800) AS lo, coalesce((w * 800 + 1000 + lead(w * 800) OVER o) / 2.0, w * 800 + 1001) AS hi FROM (SELECT DISTINCT rec_id, w FROM t) WINDOW o AS (PARTITION BY rec_id ORDER BY w))
        SELECT t.rec_id, t.w AS "window", count(*) AS tokens, min(at_ms) AS first, max(at_ms) AS last FROM t JOIN s ON t.rec_id = s.rec_id AND t.w = s.w WHERE at_ms >= lo AND at_ms < hi GROUP BY ALL""",
    "http_bases": "SELECT page_id, regexp_matches(url, '^https?://[^/?#@]+(/[^?#]*)?$') AS base FROM pages",
    "feed_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
    "paragraph_lines": """WITH l AS (SELECT doc_id::VARCHAR AS doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
        p AS (SELECT doc_id, n // 4 AS k, sum(length(t)) + count(*) - 1 AS chars FROM l GROUP BY ALL) SELECT doc_id, count(*) AS paragraphs, max(chars)::INTEGER AS longest FROM p GROUP BY doc_id""",
    "text_paragraphs": """WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM (SELECT doc_id, regexp_replace(text, '\\r\\n|\\r', chr(10), 'g') AS t FROM documents)),
        r AS (SELECT *, sum((line = '')::INTEGER) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM l),
        p AS (SELECT doc_id, run, string_agg(line, chr(10) ORDER BY n) AS text FROM r WHERE line <> '' GROUP BY ALL)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY run))::INTEGER AS paragraph, text FROM p""",
    "text_markdown": r"""WITH e AS (SELECT doc_id, regexp_replace(replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '&', '&amp;'), '([\\`*\[\]<~_])', '\\\1', 'g') AS t FROM documents),
        u AS (SELECT doc_id, regexp_replace(t, '([\p{L}\p{N}])\\_([\p{L}\p{N}])', '\1_\2', 'g') AS t FROM e)
        SELECT doc_id, replace(regexp_replace(t, '([\p{L}\p{N}])\\_([\p{L}\p{N}])', '\1_\2', 'g'), chr(10), '  ' || chr(10)) || chr(10) AS markdown FROM u""",
    "html_escape": """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""",
    "html_metadata": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, 'charset="([^"]*)"', 1) AS charset FROM pages""",
    "safe_links": r"""SELECT page_id, count(*) AS links, sum((href <> '' AND NOT contains(href, '&') AND NOT regexp_matches(href, '[\x00-\x20]') AND NOT regexp_matches(href, '(?i)^(javascript|data|vbscript|file):'))::BIGINT)::BIGINT AS safe FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""",
    "delimited_table": "SELECT n_nationkey, '| ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' | ' || n_regionkey || ' |' AS row FROM nation",
    "json_lines": "SELECT event_id, '`k`: `' || (props->>'$.k') || '`' AS line FROM events",
    "media_clock": "SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock FROM (SELECT event_id, event_id * 1234567 % 360000000 AS ms FROM events)",
    "cell_names": "SELECT o_orderkey, (CASE WHEN c >= 702 THEN chr((65 + ((c // 26 - 1) // 26 - 1) % 26)::INTEGER) ELSE '' END) || (CASE WHEN c >= 26 THEN chr((65 + (c // 26 - 1) % 26)::INTEGER) ELSE '' END) || chr((65 + c % 26)::INTEGER) || (o_orderkey + 1) AS cell FROM (SELECT o_orderkey, o_orderkey % 16384 AS c FROM orders)",
    "footnote_labels": "SELECT n_nationkey, 'fn-' || lower(hex(encode(n_name))) AS label FROM nation",
    "text_safety": "SELECT doc_id, true AS valid, regexp_matches(text, '\\S') AS visible, round((length(text) - length(replace(text, '�', '')))::DOUBLE / greatest(length(text), 1), 6) AS replaced FROM documents",
    "format_hints": """SELECT o_orderkey AS doc_id,
        CASE WHEN o_orderkey % 3 = 0 THEN (CASE o_orderkey % 8 WHEN 1 THEN 'markdown' WHEN 4 THEN 'csv' WHEN 7 THEN 'docx' ELSE 'html' END)
             ELSE (CASE o_orderkey % 8 WHEN 0 THEN 'text' WHEN 1 THEN 'markdown' WHEN 2 THEN 'html' WHEN 3 THEN 'json' WHEN 4 THEN 'csv' WHEN 5 THEN 'rar' WHEN 7 THEN 'docx' END) END AS format,
        CASE o_orderkey % 8 WHEN 1 THEN 0.99 WHEN 4 THEN 0.99 WHEN 7 THEN 0.91 ELSE (CASE WHEN o_orderkey % 3 = 0 THEN (CASE WHEN o_orderkey % 8 = 2 THEN 0.68 ELSE 0.60 END) WHEN o_orderkey % 8 = 5 THEN 0.05 ELSE 0.55 END) END::DOUBLE AS confidence
        FROM orders WHERE o_orderkey % 8 <> 6 OR o_orderkey % 3 = 0""",
    "converter_choice": """SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'markdown' WHEN 2 THEN 'html' WHEN 3 THEN 'json' ELSE 'csv' END AS format,
        CASE o_orderkey % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'markdown' WHEN 2 THEN 'html' WHEN 3 THEN 'structured' ELSE 'delimited' END AS converter_id,
        CASE WHEN o_orderkey % 6 IN (1, 4) THEN 0.99 ELSE 0.55 END::DOUBLE AS score FROM orders WHERE o_orderkey % 6 <> 5""",
    "resource_limits": "SELECT *, CASE WHEN limit_name IS NOT NULL THEN 'resourceLimit' END AS error_code FROM (SELECT *, CASE WHEN max_input_bytes > 8000 THEN 'max_input_bytes' WHEN max_lines > 10 THEN 'max_lines' END AS limit_name FROM (SELECT doc_id, strlen(text)::INTEGER AS max_input_bytes, len(string_split(text, chr(10)))::INTEGER AS max_lines FROM documents))",
    "running_matter": r"""WITH x AS (SELECT source AS doc_id, doc_id AS page, 'header' AS side, string_split(text, chr(10))[1] AS text FROM documents UNION ALL SELECT source, doc_id, 'footer', string_split(text, chr(10))[-1] FROM documents)
        SELECT doc_id, side, text, count(DISTINCT page) AS pages FROM (SELECT doc_id, page, side, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM x) WHERE text <> '' GROUP BY ALL HAVING count(DISTINCT page) >= 2""",
    "feed_dedup": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "asset_plan": "SELECT sha256, min(doc_id) AS first, count(*) AS uses, false AS conflict, 'asset-' || sha256 || '.txt' AS filename FROM (SELECT doc_id, sha256(text) AS sha256 FROM documents) GROUP BY sha256",
    "list_numbering": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '. ' || role AS item FROM conversations",
    "speaker_merge": """WITH e AS (SELECT user_id AS rec_id, event_id * 700 AS start_ms, event_id * 700 + 400 AS end_ms, event_type AS speaker, event_id FROM events),
        b AS (SELECT *, CASE WHEN lag(end_ms) OVER w IS NULL OR lag(speaker) OVER w <> speaker OR start_ms - lag(end_ms) OVER w > 150000 THEN 1 ELSE 0 END AS brk FROM e WINDOW w AS (PARTITION BY rec_id ORDER BY start_ms)),
        g AS (SELECT *, sum(brk) OVER (PARTITION BY rec_id ORDER BY start_ms) AS island FROM b)
        SELECT rec_id, min(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(event_id::VARCHAR, ' ' ORDER BY start_ms) AS text, count(*) AS parts FROM g GROUP BY rec_id, island""",
    "token_turns": "SELECT o_orderkey AS turn, count(*) AS tokens, max(l_orderkey * 1000 + l_linenumber * 150) AS last FROM orders JOIN lineitem ON l_orderkey % 50 = o_orderkey % 50 AND l_orderkey * 1000 + l_linenumber * 150 >= o_orderkey * 1000 AND l_orderkey * 1000 + l_linenumber * 150 < o_orderkey * 1000 + 700 AND l_orderkey BETWEEN o_orderkey - 2 AND o_orderkey + 2 GROUP BY o_orderkey",
    "region_overlap": """WITH p AS (SELECT p_partkey % 20 AS page_id, p_partkey AS k, (p_partkey * 37 % 900)::DOUBLE AS x, (p_partkey * 11 % 40)::DOUBLE AS y, p_partkey % 3 AS t FROM part)
        SELECT page_id, kept, dropped, round(o, 6) AS overlap FROM (SELECT a.page_id, a.k AS kept, b.k AS dropped, greatest(0, least(a.x, b.x) + 120 - greatest(a.x, b.x)) * greatest(0, least(a.y, b.y) + 20 - greatest(a.y, b.y)) / 2400.0::DOUBLE AS o
        FROM p a JOIN p b ON a.page_id = b.page_id AND a.t = b.t AND a.k < b.k) WHERE o >= 0.55""",
    "quality_audit": """WITH e AS (SELECT lang, source, count(*) AS e FROM documents GROUP BY ALL), a AS (SELECT lang, source, count(*) AS a FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL),
        x AS (SELECT e.lang, e.e, coalesce(a.a, 0) AS a FROM e LEFT JOIN a ON e.lang = a.lang AND e.source = a.source)
        SELECT lang, sum(least(e, a))::BIGINT AS tp, sum(e)::BIGINT AS expected, sum(a)::BIGINT AS actual, (CASE WHEN sum(a) = 0 THEN 10000 ELSE sum(least(e, a)) * 10000 // sum(a) END)::BIGINT AS precision_bp, (CASE WHEN sum(e) = 0 THEN 10000 ELSE sum(least(e, a)) * 10000 // sum(e) END)::BIGINT AS recall_bp FROM x GROUP BY lang""",
    "node_differences": """SELECT o_orderkey AS id, 'missing' AS kind, o_orderstatus AS expected, NULL::VARCHAR AS actual FROM orders WHERE o_orderkey % 5 = 0
        UNION ALL SELECT -o_orderkey - 1, 'unexpected', NULL, CASE WHEN o_orderkey % 7 = 0 THEN '?' ELSE o_orderstatus END FROM orders WHERE o_orderkey % 5 = 0
        UNION ALL SELECT o_orderkey, 'changed', o_orderstatus, '?' FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0""",
    "orphan_references": "SELECT lang, count(*) AS unlabelled FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang",
    "batch_report": "SELECT lang, outcome, count(*) AS items, sum(n_chars)::BIGINT AS chars FROM (SELECT *, CASE WHEN n_chars > 3000 THEN 'degraded' ELSE 'complete' END AS outcome FROM documents) GROUP BY ROLLUP (lang, outcome)",
    "keyset_page": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') < '1997-06-01' OR (strftime(o_orderdate, '%Y-%m-%d') = '1997-06-01' AND o_orderkey < 0) ORDER BY day DESC, o_orderkey DESC LIMIT 100",
    "output_names": "SELECT c_custkey, target, CASE WHEN n = 1 THEN target ELSE replace(target, '.md', '-' || n || '.md') END AS output FROM (SELECT c_custkey, 'out/' || lower(c_mktsegment) || '.md' AS target, row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY c_custkey) AS n FROM customer)",
    "heading_levels": "SELECT page, p_partkey, (CASE WHEN r >= 2 THEN 1 WHEN r >= 1.65 THEN 2 WHEN r >= 1.4 THEN 3 WHEN r >= 1.25 THEN 4 ELSE 0 END)::INTEGER AS level FROM (SELECT p_partkey % 10 AS page, p_partkey, p_size::DOUBLE / median(p_size::DOUBLE) OVER (PARTITION BY p_partkey % 10) AS r FROM part)",
    "ancestry": "SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS ancestor, 1::INTEGER AS distance FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 1 FROM customer UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "robust_values": "SELECT event_type, round(avg(value), 6) AS robust FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r <= greatest(1, ceil(n / 4.0)) GROUP BY event_type",
    "patched_nodes": "SELECT n_regionkey AS doc_id, n_nationkey AS node_id, CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END AS text FROM nation UNION ALL SELECT n_regionkey, 1000, n_name FROM nation WHERE n_nationkey = 1",
    "daily_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
