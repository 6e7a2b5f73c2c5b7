"""Queries of the task store's operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import tasks
from docloom.plans import queries
from docloom.session import table

STATES = ("pending", "running", "converted", "succeeded", "failed", "interrupted", "cancelled")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), _pick(STATES, k).alias("status"), (k % 3 == 0).alias("pinned"))


def task_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks, their lines as what the web knows of them: pinned and active ones last shipped in 1995."""
    web = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.concat(F.lit("Ship "), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd")).alias("name"), F.max("l_returnflag").alias("batch"), F.max("l_linestatus").alias("workflow"))
    return tasks.select_tasks(tasks.with_web(_tasks(spark, sf_dir), web), pinned=True, search="SHIP 1995", active=True).select("id", "status", "name", "batch", "workflow")


def task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.task_counts(_tasks(spark, sf_dir), "status")


def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of states of each user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", _pick(STATES, F.col("event_id")).alias("status"))
    return tasks.state_log(e, "user_id", "event_id")


def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stages of each user's conversion."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", _pick(tuple(tasks.STAGES), F.col("event_id")).alias("stage"))
    return tasks.progress(e, "user_id", "event_id")


def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tasks.preview(F.col("text"), 1000).alias("p")).select("doc_id", "p.text", "p.truncated")


def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality audit against the gates of two cohorts."""
    cohort = F.when(F.col("lang") == "en", "modern").otherwise("geometryDerived")
    return tasks.quality_gate(queries.quality_audit(spark, sf_dir).withColumn("cohort", cohort)).select("lang", "cohort", "passed")


def truncated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three turns of each conversation, and how many are left out."""
    return tasks.truncate_sequence(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 3)


def formats_without_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as formats, orders as fixtures."""
    return tasks.without_fixture(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("format")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("format")))


QUERIES = {f.__name__: f for f in (task_list, task_counts, task_states, task_progress, text_previews, quality_gates, truncated_turns, formats_without_fixture)}

_STATUS = "(CASE {0} % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'converted' WHEN 3 THEN 'succeeded' WHEN 4 THEN 'failed' WHEN 5 THEN 'interrupted' ELSE 'cancelled' END)"

ORACLES = {
    "task_list": f"""SELECT o_orderkey AS id, {_STATUS.format("o_orderkey")} AS status, name, batch, workflow FROM orders
        JOIN (SELECT l_orderkey, 'Ship ' || strftime(max(l_shipdate), '%Y-%m-%d') AS name, max(l_returnflag) AS batch, max(l_linestatus) AS workflow FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
        WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 < 3 AND contains(name, 'Ship 1995')""",
    "task_counts": f"SELECT {_STATUS.format('o_orderkey')} AS status, count(*) AS tasks, max(o_orderkey) AS latest FROM orders GROUP BY 1",
    "task_states": f"""WITH e AS (SELECT user_id, event_id, event_id % 7 AS s, lag(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
        SELECT user_id, event_id, {_STATUS.format("event_id")} AS status, CASE WHEN b IS NULL THEN s = 0 ELSE b <= 2 AND (s = b + 1 OR s >= 4) END AS allowed FROM e""",
    "task_progress": """WITH e AS (SELECT user_id, event_id, ['resolving', 'detecting', 'probing', 'converting', 'ocr', 'ai', 'rendering', 'completed'][event_id % 8 + 1] AS stage,
            [0, 1, 2, 3, 3, 3, 4, 5][event_id % 8 + 1] AS rank, [0, 1500, 3000, 4500, 4500, 4500, 8000, 10000][event_id % 8 + 1] AS p FROM events)
        SELECT user_id, event_id, stage, (max(p) OVER w)::INTEGER AS points, coalesce(rank >= lag(rank) OVER w, true) AS monotone FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "text_previews": "SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN text ELSE left(text, list_max(list_filter(range(250, 1001), lambda n: strlen(left(text, n)) <= 1000))) END AS text, strlen(text) > 1000 AS truncated FROM documents",
    "quality_gates": f"""SELECT lang, CASE WHEN lang = 'en' THEN 'modern' ELSE 'geometryDerived' END AS cohort, least(precision_bp, recall_bp) >= (CASE WHEN lang = 'en' THEN 9500 ELSE 9000 END) AS passed FROM ({queries.ORACLES["quality_audit"]})""",
    "truncated_turns": "SELECT conv_id, turn, greatest(0, n - 3) AS omitted FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE r <= 3",
    "formats_without_fixture": "SELECT c_custkey AS format FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
}
