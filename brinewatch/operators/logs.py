"""Events written as a log of JSON lines and read from it, whole, from a number on, and as a stream (S1, S2)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brinewatch.sources import jsonlog
from brinewatch.sources.tables import read, shared_dir
from brinewatch.streaming import flows

FIELDS = "sequence long, event_type string, user_id long, value double, props string, us long"


def lines(events: DataFrame) -> DataFrame:
    """(seq, payload): events as JSON objects."""
    return events.select(F.col("event_id").alias("seq"), F.to_json(F.struct(F.col("event_id").alias("sequence"), "event_type", "user_id", "value", "props", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))).alias("payload"))


def fields(payload: Column) -> Column:
    return F.from_json(payload, FIELDS)


def logged(s: SparkSession, d: str) -> tuple[str, int]:
    """The test events as a log of some ten segments; and the number that half of them come before."""
    events = read(s, d, "events")
    top = events.agg(F.max("event_id")).first()[0]
    path = f"{shared_dir(s)}/log-{uuid.uuid4().hex}"
    jsonlog.write(lines(events), path, max(1, top // 10))
    return path, top // 2


def _whole(s, d):
    path, _ = logged(s, d)
    return jsonlog.scan(s, path, size=1 << 16).select(fields(F.col("payload")).alias("e")).select("e.*")


def _from(s, d):
    path, half = logged(s, d)
    return jsonlog.scan(s, path, half).select("seq", fields(F.col("payload")).alias("e")).groupBy("e.event_type").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def _streamed(s, d):
    path, half = logged(s, d)
    rows = flows.drained(jsonlog.stream(s, path, half).select("seq", fields(F.col("payload")).alias("e")).select("seq", "e.user_id", "e.value"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("seq").alias("last"))


QUERIES = {"s1_json_lines": _whole, "s2_from_sequence": _from, "s2_streamed": _streamed}
ORACLE = {
    "s1_json_lines": "SELECT event_id AS sequence, event_type, user_id, value, props, epoch_us(ts) AS us FROM events",
    "s2_from_sequence": "SELECT event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events WHERE event_id >= (SELECT max(event_id) // 2 FROM events) GROUP BY event_type",
    "s2_streamed": "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(event_id) AS last FROM events WHERE event_id >= (SELECT max(event_id) // 2 FROM events) GROUP BY user_id",
}
