"""Stateful processors with values, lists and event-time timers: first in a period (events, alerts), drift before update, micro-batches by size, age and urgency.

A processor sees a key's rows (first in a period: those of a bucket of keys) of a micro-batch in the order of event time and keeps a few values a key. Timers go by event time, so a run over old events gives what a live one gave; state of a key whose
period is over is cleared when the watermark passes it. Streams must come in order up to the watermark's delay; results don't hang on how they are cut into micro-batches.
State lives in the RocksDB provider; a query that stops goes on from its checkpoint.
"""

from __future__ import annotations

import contextlib
import hashlib
import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brinewatch.sources.tables import shared_dir
from brinewatch.streaming import flows

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Processors need this provider when a query starts; what the session had comes back."""
    before = spark.conf.get(*PROVIDER[:1], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)


def run(flow: DataFrame, path: str | None = None) -> DataFrame:
    """Drains what is there into rows below path (a new folder if none), with the epoch of each; run again with the same path, it goes on from its checkpoint."""
    spark = flow.sparkSession
    path = path or f"{shared_dir(spark)}/stateful-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")  # a batch that runs again replaces itself

    with rocksdb(spark):
        flow.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(flow.schema.add("epoch", "long")).parquet(f"{path}/rows")


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch."""
    return pd.concat(rows, ignore_index=True).sort_values(by, kind="stable")


class FirstInPeriod(StatefulProcessor):
    """Keeps a key's row if none was kept in the period before it (fixed from that one: dropped rows don't prolong it).

    State is by bucket of keys, a list of (key, time last kept) that new ones are appended to: a call, its round trips to the state store and its frames serve thousands of keys. The list is
    written anew once half of it is replaced or over, and cleared when its last period is.
    """

    def __init__(self, period_ms: int, columns: list[str]) -> None:
        self.period, self.columns = period_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getListState("kept", "key string, ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = _ordered(rows, ["key_text", "ms", "event_id"])
        stored = [(r[0], r[1]) for r in self.kept.get()] if self.kept.exists() else []
        held = dict(stored)  # what was appended last holds
        first = max(held.values(), default=None)
        new, chosen = {}, []
        for i, (k, ms) in enumerate(zip(x["key_text"].tolist(), x["ms"].tolist(), strict=True)):
            last = new[k] if k in new else held.get(k)
            if last is None or ms - last >= self.period:
                new[k] = ms
                chosen.append(i)
        if new:
            over = timerValues.getCurrentWatermarkInMs() - self.period
            live = {k: ms for k, ms in held.items() if ms > over} | new
            if 2 * len(live) < len(stored) + len(new) or not stored:
                self.kept.put(list(live.items()))
            else:
                self.kept.appendList(list(new.items()))
            last = max(live.values())
            if last != first:
                if first is not None:
                    self.handle.deleteTimer(first + self.period)
                self.handle.registerTimer(last + self.period)
            yield x.iloc[chosen][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield from ()

    def close(self) -> None:
        pass


class Drift(StatefulProcessor):
    """Each event's distance from its key's mean before it, in deviations, then the update (Welford); anomalies are beyond the threshold once there are LEAST events.

    A key's results of a micro-batch end in a hash over them in order and over the hash before, so that a replay can be compared.
    """

    LEAST = 10

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.baseline = handle.getValueState("baseline", "n long, mean double, m2 double, version long, hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = _ordered(rows, ["ms", "event_id"])
        n, mean, m2, version, last = self.baseline.get() if self.baseline.exists() else (0, 0.0, 0.0, 0, "")
        scores = []
        for v in x["value"].tolist():
            deviation = math.sqrt(m2 / n) if n else 0.0
            scores.append(abs(v - mean) / deviation if deviation > 1e-9 else 0.0)
            n += 1
            d = v - mean
            mean += d / n
            m2 += d * (v - mean)
        before = n - len(scores)
        out = pd.DataFrame({"event_id": x["event_id"].to_numpy(), "user_id": key[0], "score": scores})
        out["anomaly"] = [s > self.threshold and before + i >= self.LEAST for i, s in enumerate(scores)]
        digest = hashlib.sha256(last.encode())
        for e, s, a in zip(out["event_id"], out["score"], out["anomaly"], strict=True):
            digest.update(f"{e}:{s:.6f}:{int(a)};".encode())
        out["n"], out["version"], out["batch_hash"] = range(before, n), version + 1, digest.hexdigest()
        self.baseline.update((n, mean, m2, version + 1, digest.hexdigest()))
        yield out[["event_id", "user_id", "score", "anomaly", "n", "version", "batch_hash"]]

    def close(self) -> None:
        pass


class MicroBatches(StatefulProcessor):
    """Collects a lane's events and closes a batch at so many, so old, or with an urgent one.

    An event that comes when the batch is age old closes it before it enters the next; a timer closes one that nothing follows.
    """

    OUT = "lane long, batch long, n long, reason string, first_ms long, last_ms long, first_id long, last_id long"

    def __init__(self, size: int, age_ms: int) -> None:
        self.size, self.age = size, age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.batch = handle.getValueState("batch", "number long")
        self.open = handle.getListState("open", "ms long, id long")

    def _closed(self, key, held: list, reason: str) -> tuple:
        number = self.batch.get()[0] if self.batch.exists() else 0
        self.batch.update((number + 1,))
        return (key[0], number, len(held), reason, held[0][0], held[-1][0], held[0][1], held[-1][1])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = _ordered(rows, ["ms", "event_id"])
        held = [(r[0], r[1]) for r in self.open.get()] if self.open.exists() else []
        first = held[0][0] if held else None
        out = []
        for ms, e, urgent in zip(x["ms"].tolist(), x["event_id"].tolist(), x["urgent"].tolist(), strict=True):
            if held and ms - held[0][0] >= self.age:
                out.append(self._closed(key, held, "age"))
                held = []
            held.append((ms, e))
            if urgent or len(held) >= self.size:
                out.append(self._closed(key, held, "critical_priority" if urgent else "size"))
                held = []
        now = held[0][0] if held else None
        if now != first:
            if first is not None:
                self.handle.deleteTimer(first + self.age)
            if now is not None:
                self.handle.registerTimer(now + self.age)
        self.open.put(held) if held else self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [(r[0], r[1]) for r in self.open.get()] if self.open.exists() else []
        if held:
            self.open.clear()
            yield pd.DataFrame([self._closed(key, held, "age")], columns=[c.split()[0] for c in self.OUT.split(", ")])

    def close(self) -> None:
        pass


def _timed(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", delay)


def first_in_period(events: DataFrame, keys: list[str], seconds: int, delay: str = "0 seconds", buckets: int = 1024) -> DataFrame:
    """(event_id, keys, ms): one event of a key in each period, counted from the last one kept. A task holds a micro-batch's rows of one of so many buckets of keys; nulls are keys."""
    columns = ["event_id", *keys, "ms"]
    key = F.to_json(F.struct(*(F.col(k) for k in keys)))
    x = _timed(events, delay).select("ts", *columns, key.alias("key_text")).withColumn("key_bucket", F.pmod(F.xxhash64("key_text"), F.lit(buckets)))
    schema = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in columns)
    return x.groupBy("key_bucket").transformWithStateInPandas(FirstInPeriod(1000 * seconds, columns), schema, "append", "eventTime")


def drift(events: DataFrame, threshold: float = 3.0, delay: str = "0 seconds") -> DataFrame:
    """(event_id, user_id, score, anomaly, n, version, batch_hash): every event against its user's baseline before it."""
    out = "event_id long, user_id long, score double, anomaly boolean, n long, version long, batch_hash string"
    return _timed(events, delay).groupBy("user_id").transformWithStateInPandas(Drift(threshold), out, "append", "none")


def micro_batches(events: DataFrame, urgent: str, size: int = 100, seconds: int = 5, lanes: int = 16, delay: str = "0 seconds") -> DataFrame:
    """Closed batches of each lane (users dealt over lanes)."""
    x = _timed(events, delay).withColumn("lane", F.pmod("user_id", F.lit(lanes))).withColumn("urgent", F.coalesce(F.expr(urgent), F.lit(False)))
    return x.groupBy("lane").transformWithStateInPandas(MicroBatches(size, 1000 * seconds), MicroBatches.OUT, "append", "eventTime")


PERIOD, AGE, SIZE = 6 * 3600, 12 * 3600, 12
URGENT = "event_type = 'error' and value > 45"


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    """Errors and purchases as alerts of a type, an actor, a role and a token."""
    alerts = flows.source(spark, d).where("event_type in ('error', 'purchase')").withColumn("role", F.concat(F.lit("role-"), F.col("user_id") % 7)).withColumn("token", F.regexp_extract("props", "([0-9])", 1))
    return run(first_in_period(alerts, ["event_type", "user_id", "role", "token"], 20 * 3600)).select("event_id", "event_type", "user_id", "role", "token")


QUERIES = {
    "d1_streamed": lambda s, d: run(first_in_period(flows.source(s, d), ["user_id", "event_type"], PERIOD)).select("event_id", "user_id", "event_type"),
    "d4_streamed_alerts": _alerts,
    "bl9_streamed_drift": lambda s, d: run(drift(flows.source(s, d), 2.0)).select("event_id", "user_id", F.round("score", 4).alias("score"), "anomaly", "n"),
    "k2_micro_batches": lambda s, d: run(micro_batches(flows.source(s, d), URGENT, SIZE, AGE)).select("lane", "batch", "n", "reason", "first_id", "last_id"),
}


def _kept(keys: str, rows: str, ms: int) -> str:
    """One row after another: kept if the last kept one of its keys is a period ago."""
    return f"""WITH RECURSIVE o AS (SELECT *, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY {keys} ORDER BY epoch_ms(ts), event_id) AS r FROM ({rows})),
 w AS (SELECT *, ms AS last, true AS kept FROM o WHERE r = 1 UNION ALL SELECT o.*, CASE WHEN o.ms - w.last >= {ms} THEN o.ms ELSE w.last END, o.ms - w.last >= {ms} FROM w JOIN o ON {' AND '.join(f'o.{k} = w.{k}' for k in keys.split(', '))} AND o.r = w.r + 1)
 SELECT event_id, {keys} FROM w WHERE kept"""


ORACLE = {
    "d1_streamed": _kept("user_id, event_type", "SELECT * FROM events", 1000 * PERIOD),
    "d4_streamed_alerts": _kept("event_type, user_id, role, token", "SELECT *, 'role-' || user_id % 7 AS role, regexp_extract(props, '([0-9])', 1) AS token FROM events WHERE event_type IN ('error', 'purchase')", 20 * 3_600_000),
    "bl9_streamed_drift": f"""WITH p AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 z AS (SELECT *, CASE WHEN n > 0 AND s > 1e-9 THEN abs(value - m) / s ELSE 0 END AS x FROM p) SELECT event_id, user_id, round(x, 4) AS score, x > 2 AND n >= {Drift.LEAST} AS anomaly, n FROM z""",
    "k2_micro_batches": f"""WITH RECURSIVE o AS (SELECT event_id, user_id % 16 AS lane, epoch_ms(ts) AS ms, coalesce(event_type = 'error' AND value > 45, false) AS u, row_number() OVER (PARTITION BY user_id % 16 ORDER BY epoch_ms(ts), event_id) AS r FROM events),
 w AS (SELECT *, 0::BIGINT AS batch, 1::BIGINT AS n, ms AS f, u AS done FROM o WHERE r = 1
  UNION ALL SELECT o.*, w.batch + (w.done OR o.ms - w.f >= {1000 * AGE})::BIGINT, CASE WHEN w.done OR o.ms - w.f >= {1000 * AGE} THEN 1 ELSE w.n + 1 END, CASE WHEN w.done OR o.ms - w.f >= {1000 * AGE} THEN o.ms ELSE w.f END, o.u OR (CASE WHEN w.done OR o.ms - w.f >= {1000 * AGE} THEN 1 ELSE w.n + 1 END) >= {SIZE} FROM w JOIN o ON o.lane = w.lane AND o.r = w.r + 1),
 b AS (SELECT lane, batch, max(n) AS n, min(f) AS f, min_by(event_id, r) AS first_id, max_by(event_id, r) AS last_id, max_by(u, r) AS u, max_by(done, r) AS done FROM w GROUP BY lane, batch), m AS (SELECT max(epoch_ms(ts)) AS now FROM events)
 SELECT lane, batch, n, CASE WHEN u THEN 'critical_priority' WHEN done THEN 'size' ELSE 'age' END AS reason, first_id, last_id FROM b, m WHERE done OR f + {1000 * AGE} <= now OR batch < (SELECT max(batch) FROM b c WHERE c.lane = b.lane)""",
}
