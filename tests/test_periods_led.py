"""What a period needs of those before it comes in its own stream: no window of a cut-up history joins its rows; what comes along with first_in_period."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewatch.functions import periods
from brinewatch.operators import intake


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_window_joins_its_rows(spark):
    df = periods.cut_up(spark.createDataFrame([(i, "a", i * 7 % 50, 1) for i in range(40)], "event_id long, key string, us long, d int"), 10)
    for x in (periods.neighbours(df, ["key"], ["us"]), periods.running_sum(df, ["key"], "d", "n"), periods.least_before(df, ["key"], F.col("d"), "m")):
        assert "Join" not in plan(x)


def test_null_sums_and_empty_periods(spark):
    rows = [(1, "a", 1, None), (2, "a", 12, 5), (3, "a", 95, None), (4, None, 3, 2), (5, None, 55, 3)]
    df = periods.cut_up(spark.createDataFrame(rows, "event_id long, key string, us long, d int"), 10)
    assert {r.event_id: r.n for r in periods.running_sum(df, ["key"], "d", "n").collect()} == {1: None, 2: 5, 3: 5, 4: 2, 5: 5}
    assert {r.event_id: r.m for r in periods.least_before(df, ["key"], F.col("d"), "m").collect()} == {1: None, 2: None, 3: 5, 4: None, 5: 2}


def test_first_in_period_with_more(spark):
    rows = [(1, "a", 0, "x"), (1, "a", 0, "y"), (2, "a", 5, "x"), (3, "a", 20, "x"), (3, "a", 20, "z"), (4, None, 1, "x"), (4, None, 1, "y"), (5, None, 2, "x")]
    df = spark.createDataFrame(rows, "event_id long, key string, us long, kind string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)  # an event's rows lie in two batches
    try:
        got = sorted((r.event_id, r.kind) for r in intake.first_in_period(df, ["key"], 10, ["kind"]).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(1, "x"), (1, "y"), (3, "x"), (3, "z"), (4, "x"), (4, "y")]
    assert sorted(r.event_id for r in intake.first_in_period(df, ["key"], 10).collect()) == [1, 3, 4]
