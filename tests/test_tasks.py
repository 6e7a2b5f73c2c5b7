"""The task store's operators: against their SQL, and over odd rows."""

import duckdb
import pytest

from docloom.operators import tasks
from docloom.plans import task_queries

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "lineitem", "events", "documents", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(task_queries.QUERIES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = task_queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    assert got == sorted(map(repr, con.execute(f"SELECT {', '.join(columns)} FROM ({task_queries.ORACLES[name]})").fetchall()))


def test_previews_end_between_characters(spark):
    texts = [None, "", "abcdef", "é" * 5, "a" + "é" * 5, "€" * 4, "a€€€", "😀😀😀", "a😀😀", "ab😀😀", "abc😀😀"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", tasks.preview(df.t, 6).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i].text == (None if t is None else t.encode()[:6].decode(errors="ignore"))
        assert got[i].truncated == (None if t is None else len(t.encode()) > 6)


def test_unknown_states_cohorts_and_filters(spark):
    log = spark.createDataFrame([(1, 1, "pending"), (1, 2, "succeeded"), (1, 3, "pending"), (2, 1, "running"), (3, 1, "pending"), (3, 2, None), (3, 3, "running")], "k int, n int, status string")
    assert [r.allowed for r in tasks.state_log(log, "k", "n").orderBy("k", "n").collect()] == [True, False, False, False, True, False, False]
    audit = spark.createDataFrame([("modern", 9500, 9500), ("modern", 9499, 10000), ("geometryDerived", 9000, 9000), (None, 10000, 10000)], "cohort string, precision_bp int, recall_bp int")
    assert [r.passed for r in tasks.quality_gate(audit).collect()] == [True, False, True, False]
    assert tasks.truncate_sequence(log.limit(0), "k", "n", 2).count() == 0
    with pytest.raises(ValueError):
        tasks.select_tasks(log, search="x" * 256)
