"""The task store as tables: lists, counts, states, progress, previews, gates and bounded sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values.
ACTIVE = ("pending", "running", "converted")
TRANSITIONS = {
    "pending": ("running", "failed", "interrupted", "cancelled"),
    "running": ("converted", "failed", "interrupted", "cancelled"),
    "converted": ("succeeded", "failed", "interrupted", "cancelled"),
}
STAGES = {"resolving": (0, 0), "detecting": (1, 1500), "probing": (2, 3000), "converting": (3, 4500), "ocr": (3, 4500), "ai": (3, 4500), "rendering": (4, 8000), "completed": (5, 10_000)}
GATES = {"modern": 9500, "geometryDerived": 9000}
PREVIEW_BYTES = 256 * 1024
SEARCH_BYTES = 255


def with_web(tasks: DataFrame, web: DataFrame) -> DataFrame:
    """Tasks (id, ...) with the name, batch and workflow of those that came through the web (task_id, ...)."""
    return tasks.join(web.select(F.col("task_id").alias("id"), "name", "batch", "workflow"), "id", "left")


def select_tasks(tasks: DataFrame, status: str | None = None, pinned: bool | None = None, batch: str | None = None, workflow: str | None = None, search: str = "", active: bool | None = None) -> DataFrame:
    """Tasks that meet every filter given; `search` is part of the name in any case."""
    if len(search.encode()) > SEARCH_BYTES:
        raise ValueError(f"a search has at most {SEARCH_BYTES} bytes")
    for column, value in (("status", status), ("pinned", pinned), ("batch", batch), ("workflow", workflow)):
        if value is not None:
            tasks = tasks.where(F.col(column) == F.lit(value))
    if search:
        tasks = tasks.where(F.contains(F.lower("name"), F.lower(F.lit(search))))
    return tasks if active is None else tasks.where(F.col("status").isin(*ACTIVE) == F.lit(active))


def task_counts(tasks: DataFrame, *by: str) -> DataFrame:
    """How many tasks there are and the latest id, whole or by columns."""
    return tasks.groupBy(*by).agg(F.count("*").alias("tasks"), F.max("id").alias("latest"))


def may_follow(state: Column, following: Column) -> Column:
    """Whether a task may go from one state to the other; ended tasks stay as they are."""
    allowed = F.create_map(*[F.lit(x) for a, bs in TRANSITIONS.items() for x in (a, ",".join(bs))])
    return F.coalesce(F.find_in_set(following, F.element_at(allowed, state)) > 0, F.lit(False))


def state_log(log: DataFrame, key: str, order: str) -> DataFrame:
    """Adds `allowed` to each entry of a log of states: a task begins pending, then follows its transitions."""
    before = F.lag("status").over(W.partitionBy(key).orderBy(order))
    return log.withColumn("allowed", F.when(before.isNull(), F.col("status") == "pending").otherwise(may_follow(before, F.col("status"))))


def progress(log: DataFrame, key: str, order: str) -> DataFrame:
    """Adds `points` (basis points of a stage, never falling for a task) and `monotone` (the stage did not go back)."""
    part = lambda i: F.element_at(F.create_map(*[F.lit(x) for s, v in STAGES.items() for x in (s, v[i])]), F.col("stage"))
    w = W.partitionBy(key).orderBy(order)
    x = log.withColumn("_rank", part(0)).withColumn("points", F.max(part(1)).over(w))
    return x.withColumn("monotone", F.coalesce(F.col("_rank") >= F.lag("_rank").over(w), F.lit(True))).drop("_rank")


def preview(text: Column, most: int = PREVIEW_BYTES) -> Column:
    """struct(text, truncated): at most `most` bytes of UTF-8, cut between characters."""
    b = F.encode(text, "UTF-8")
    inside = lambda n: F.hex(F.substring(b, n, 1)).between("80", "BF")
    # The byte after the cut may not continue a character.
    end = F.when(~inside(most + 1), most).when(~inside(most), most - 1).when(~inside(most - 1), most - 2).otherwise(most - 3)
    long = F.octet_length(text) > most
    return F.struct(F.when(long, F.decode(F.substring(b, F.lit(1), end), "UTF-8")).otherwise(text).alias("text"), long.alias("truncated"))


def quality_gate(audit: DataFrame) -> DataFrame:
    """Adds `passed` to rows of precision_bp and recall_bp by their `cohort`; unknown cohorts do not pass."""
    least = F.element_at(F.create_map(*[F.lit(x) for kv in GATES.items() for x in kv]), F.col("cohort"))
    return audit.withColumn("passed", F.coalesce((F.col("precision_bp") >= least) & (F.col("recall_bp") >= least), F.lit(False)))


def truncate_sequence(units: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first `most` units of each sequence, with how many of it were omitted: a limit that says so."""
    w = W.partitionBy(key)
    x = units.withColumn("_n", F.row_number().over(w.orderBy(order))).withColumn("omitted", F.greatest(F.lit(0), F.count("*").over(w) - most))
    return x.where(F.col("_n") <= most).drop("_n")


def without_fixture(available: DataFrame, fixtures: DataFrame, key: str = "format") -> DataFrame:
    """Formats that can be read and that no fixture covers."""
    return available.select(key).distinct().join(fixtures.select(key), key, "left_anti")
