"""Streams drained into the shared folder: no row passes the driver, and several micro-batches give one result."""

from __future__ import annotations

from brinewatch.streaming import flows

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def batches(spark, tmp_path):
    for k in range(3):
        rows = spark.sql(f"SELECT id AS event_id, timestamp_ntz'2024-01-0{k + 1} 00:00:00' AS ts, id % 2 AS user_id, 'view' AS event_type, CAST(id AS double) AS value, '' AS props FROM range({k * 10}, {k * 10 + 10})")
        rows.coalesce(1).write.parquet(f"{tmp_path}/{k}")
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path)).withColumn("ts", flows.F.col("ts").cast("timestamp"))


def test_the_last_update_of_each_user(spark, tmp_path):
    got = {r.user_id: (r.n, round(r["mean"], 6)) for r in flows.latest(flows.drift(batches(spark, tmp_path)), "user_id").collect()}
    assert got == {0: (15, 14.0), 1: (15, 15.0)}


def test_every_row_is_drained(spark, tmp_path):
    got = flows.drained(flows.unique(batches(spark, tmp_path)).select("event_id", "user_id"))
    assert sorted(r.event_id for r in got.collect()) == list(range(30)) and got.columns == ["event_id", "user_id", "epoch"]


def test_rows_do_not_pass_the_driver(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("in-memory table")

    monkeypatch.setattr(flows, "run_now", refuse)
    for name in ("k6_unique_events", "s9_drift"):
        assert flows.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_drift_is_in_order_over_arrow_batches(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, timestamp_micros(1704067200000000 + (id * 37 % 101) * 1000000)::timestamp_ntz AS ts, 1L AS user_id, 'view' AS event_type, CAST((id * 37 % 101) * (id * 37 % 101 + 7) AS double) AS value, '' AS props FROM range(101)")
    rows.coalesce(1).write.parquet(f"{tmp_path}/0")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10")
    try:
        events = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(str(tmp_path)).withColumn("ts", flows.F.col("ts").cast("timestamp"))
        got = flows.latest(flows.drift(events), "user_id").first()
    finally:
        spark.conf.set(name, before)
    seen, worst = [], 0.0
    for x in (float(i * (i + 7)) for i in range(101)):
        if len(seen) > 1:
            mean = sum(seen) / len(seen)
            worst = max(worst, abs(x - mean) / (sum((y - mean) ** 2 for y in seen) / len(seen)) ** 0.5)
        seen.append(x)
    assert got.n == 101 and abs(got.worst - worst) < 1e-6
