"""The same operators over streams: intake with dead letters, windowed counts under a watermark, deduplication, drift with state.

Each flow takes a streaming DataFrame of raw events (event_id, ts, user_id, event_type, value, props) and returns one. run_now and drained drain
what is there into a table or the shared folder and stop, for batch use and tests.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brinewatch.sources.tables import shared_dir

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, pattern: str = "events.parquet", files: int = 1000) -> DataFrame:
    """Events of a folder as a stream, with event times that can have a watermark."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def counts(events: DataFrame, late: str = "7 days", size: str = "1 day") -> DataFrame:
    """Events by window and type; what is later than the watermark is dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def unique(events: DataFrame, late: str = "7 days") -> DataFrame:
    """One event per id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def drift(events: DataFrame) -> DataFrame:
    """Each user's count, mean and deviation so far, and the largest z of an event against those before it; state is three numbers a user."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, worst = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        # a user's rows may come in several Arrow batches, in any order: they are ordered over all of them
        for x in pd.concat(batches, ignore_index=True).sort_values(["ts", "event_id"])["value"]:
            if n > 1 and m2 > 1e-12:
                worst = max(worst, abs(x - mean) / math.sqrt(m2 / n))
            n += 1
            d = x - mean
            mean += d / n
            m2 += d * (x - mean)
        state.update((n, mean, m2, worst))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean": [mean], "deviation": [math.sqrt(m2 / n)], "worst": [worst]})

    out = "user_id long, n long, mean double, deviation double, worst double"
    return events.select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandasWithState(step, out, "n long, mean double, m2 double, worst double", "update", GroupStateTimeout.NoTimeout)


def run_now(flow: DataFrame, mode: str = "append") -> DataFrame:
    """Drains what is there into an in-memory table and returns it. For reports of bounded size."""
    name = f"flow_{uuid.uuid4().hex}"
    query = flow.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return flow.sparkSession.table(name)


def drained(flow: DataFrame, mode: str = "append") -> DataFrame:
    """Drains what is there into the shared folder and returns its rows with the epoch of each. For results of any size."""
    path, epochs = f"{shared_dir(flow.sparkSession)}/flow-{uuid.uuid4().hex}", []

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")  # a batch that runs again replaces itself
        epochs.append(epoch)

    flow.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    schema = flow.schema.add("epoch", "long")
    return flow.sparkSession.read.schema(schema).parquet(f"{path}/rows") if epochs else flow.sparkSession.createDataFrame([], schema)


def latest(flow: DataFrame, key: str) -> DataFrame:
    """The last update of each key."""
    rows = drained(flow, "update")
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in flow.columns if c != key)), "epoch").alias("_x")).select(key, "_x.*")


def fan_out(flow: DataFrame, folder: str, checkpoint: str, valid: str = "event_type != 'error'") -> None:
    """Each micro-batch is split into accepted rows and dead letters, written to two folders; drains and stops."""

    def write(batch: DataFrame, epoch: int) -> None:
        ok = F.coalesce(F.expr(valid), F.lit(False))
        for name, rows in (("accepted", batch.where(ok)), ("dead", batch.where(~ok).withColumn("reason", F.lit("event_type")))):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/epoch={epoch}")  # a batch that runs again replaces itself

    flow.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through fan_out, and what each folder then holds by type."""
    folder = f"{shared_dir(spark)}/fan-{uuid.uuid4().hex}"
    fan_out(source(spark, sf_dir), folder, f"{folder}/checkpoint")
    held = [spark.read.schema(SCHEMA.replace("timestamp_ntz", "timestamp")).parquet(f"{folder}/{n}").groupBy("event_type").agg(F.count("*").alias("n")).select(F.lit(n).alias("folder"), "event_type", "n") for n in ("accepted", "dead")]
    return held[0].unionAll(held[1])


QUERIES = {
    "k2_fan_out": split,
    "k5_windowed_counts": lambda s, d: run_now(counts(source(s, d)), "complete"),
    "k6_unique_events": lambda s, d: drained(unique(source(s, d)).select("event_id", "user_id")).groupBy("user_id").agg(F.count("*").alias("n")),
    "s9_drift": lambda s, d: latest(drift(source(s, d)), "user_id").select("user_id", "n", F.round("mean", 9).alias("mean"), F.round("deviation", 7).alias("deviation"), F.round("worst", 4).alias("worst")),
}
ORACLE = {
    "k2_fan_out": "SELECT CASE WHEN event_type = 'error' THEN 'dead' ELSE 'accepted' END AS folder, event_type, count(*) AS n FROM events GROUP BY ALL",
    "k5_windowed_counts": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "k6_unique_events": "SELECT user_id, count(DISTINCT event_id) AS n FROM events GROUP BY user_id",
    "s9_drift": """WITH p AS (SELECT user_id, value, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 z AS (SELECT user_id, coalesce(max(abs(value - m) / s) FILTER (n > 1 AND s > 1e-6), 0) AS worst FROM p GROUP BY user_id) SELECT e.user_id, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_pop(value), 7) AS deviation, round(any_value(worst), 4) AS worst FROM events e JOIN z USING (user_id) GROUP BY e.user_id""",
}
