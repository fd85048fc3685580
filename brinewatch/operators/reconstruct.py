"""State at any number from stored snapshots and what follows them, without reading the ledger before.

The ledger is stored by ranges of numbers, snapshots by their number, each actor's row with a digest. For every number asked for, the nearest sound snapshot at or before it is
found by an as-of join; then only the ranges between the two are read (their folders are named in the filter, so nothing else is listed or opened), and merged
with the snapshot. A snapshot with a row that doesn't fit its digest, or with fewer rows than were written, is not sound: the one before it serves, or in the end the ledger
from its beginning. A snapshot is itself made from the one before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brinewatch.operators import ledger
from brinewatch.sources.tables import EV, cut, events, shared_dir

STATE = "actor long, n long, last_seq long, last_action string, resources array<string>"
NAMES = [c.split()[0] for c in STATE.split(", ")]


def reduced(rows: DataFrame, *keys: str) -> DataFrame:
    """Events (actor, seq, action, resource) as states."""
    return rows.groupBy(*keys, "actor").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"), F.max_by("action", "seq").alias("last_action"), F.array_sort(F.collect_set("resource")).alias("resources"))


def merged(states: DataFrame, *keys: str) -> DataFrame:
    """States of the same actor as one; associative, so partial ones can be merged in any grouping."""
    return states.groupBy(*keys, "actor").agg(F.sum("n").alias("n"), F.max("last_seq").alias("last_seq"), F.max_by("last_action", "last_seq").alias("last_action"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("resources")))).alias("resources"))


def digest() -> Column:
    return F.sha2(F.to_json(F.struct(*NAMES)), 256)


class Store:
    """A ledger by ranges of so many numbers, and snapshots, below a folder."""

    def __init__(self, spark: SparkSession, path: str, width: int) -> None:
        self.spark, self.path, self.width = spark, path, width

    def write_ledger(self, rows: DataFrame) -> None:
        rows.select("seq", "actor", "action", "resource", F.expr(f"seq div {self.width}").alias("range")).write.partitionBy("range").parquet(f"{self.path}/ledger")

    def ledger(self, after: int, until: int) -> DataFrame:
        """The records of numbers over `after` up to `until`: a filter on the folders and one on the rows."""
        rows = self.spark.read.schema("seq long, actor long, action string, resource string, range long").parquet(f"{self.path}/ledger")
        return rows.where(F.col("range").between(max(after + 1, 0) // self.width, until // self.width) & (F.col("seq") > after) & (F.col("seq") <= until))

    def write_snapshot(self, seq: int, damage: Column | None = None) -> None:
        """The state after number seq, from the newest sound snapshot before it."""
        state = cut(self.at([seq]).select(*NAMES).withColumn("digest", digest()))
        n = state.count()
        (state if damage is None else state.withColumn("n", F.when(damage, F.col("n") + 1).otherwise(F.col("n")))).withColumns({"rows": F.lit(n), "snapshot": F.lit(seq)}).write.mode("append").partitionBy("snapshot").parquet(f"{self.path}/snapshots")

    def snapshots(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{STATE}, digest string, rows long, snapshot long").parquet(f"{self.path}/snapshots")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def sound(self) -> list[int]:
        """The numbers of snapshots of which every row fits; a row a snapshot."""
        held = self.snapshots()
        if held is None:
            return []
        by = held.groupBy("snapshot").agg(F.count("*").alias("n"), F.min("rows").alias("rows"), F.min(digest() == F.col("digest")).alias("fits"))
        return sorted(r.snapshot for r in by.where("fits and n = rows").collect())

    def bases(self, targets: list[int]) -> DataFrame:
        """(target, base): the nearest sound snapshot at or before each number, -1 where there is none."""
        asked = self.spark.createDataFrame([(t,) for t in targets], "target long")
        known = self.spark.createDataFrame([(s,) for s in self.sound()], "snapshot long")
        return asked.distinct().join(F.broadcast(known), F.col("snapshot") <= F.col("target"), "left").groupBy("target").agg(F.coalesce(F.max("snapshot"), F.lit(-1)).alias("base"))

    def at(self, targets: list[int]) -> DataFrame:
        """(target, actor, n, last_seq, last_action, resources, base): the states after each of some numbers."""
        parts = None
        for r in self.bases(targets).collect():  # a row a number asked for
            new = reduced(self.ledger(r.base, r.target)).select(*NAMES)
            if r.base >= 0:
                new = merged(new.unionAll(self.snapshots().where(F.col("snapshot") == r.base).select(*NAMES)))
            new = new.select(F.lit(r.target).cast("long").alias("target"), *NAMES, F.lit(r.base).cast("long").alias("base"))
            parts = new if parts is None else parts.unionAll(new)
        return parts if parts is not None else self.spark.createDataFrame([], f"target long, {STATE}, base long")

    def report(self, targets: list[int]) -> DataFrame:
        """(target, base, strategy, delta, missing): how each number is reached, how many records are read for it, and how many numbers lack one."""
        out = None
        for r in self.bases(targets).collect():
            strategy = "checkpoint_seek" if r.base == r.target else "snapshot_then_delta" if r.base >= 0 else "full_replay"
            one = self.ledger(r.base, r.target).agg(F.count("*").alias("delta"), F.countDistinct("seq").alias("d"))
            first = max(r.base + 1, 0)
            one = one.select(F.lit(r.target).cast("long").alias("target"), F.lit(r.base).cast("long").alias("base"), F.lit(strategy).alias("strategy"), "delta", (F.lit(r.target - first + 1) - F.col("d")).alias("missing"))
            out = one if out is None else out.unionAll(one)
        return out


def stored(s: SparkSession, d: str) -> tuple[Store, list[int]]:
    """The test ledger with three snapshots, of which the second is damaged, and five numbers to ask for."""
    log = cut(ledger.records(events(s, d)))
    top = log.agg(F.max("seq")).first()[0]
    store = Store(s, f"{shared_dir(s)}/reconstruct-{uuid.uuid4().hex}", max(1, top // 40))
    store.write_ledger(log)
    for k in (1, 2, 3):
        store.write_snapshot(k * top // 4, F.col("actor") % 9 == 4 if k == 2 else None)
    return store, [top // 8, top // 4, top // 2 + 10, 3 * top // 4 + 7, top]


def _at(s, d):
    store, targets = stored(s, d)
    return store.at(targets).withColumn("resources", F.array_join("resources", ","))


def _report(s, d):
    store, targets = stored(s, d)
    return store.report(targets)


QUERIES = {"l9_reconstructed": _at, "l9_report": _report}
_TARGETS = EV + """, lg AS (SELECT event_id AS seq, actor, action, resource FROM ev WHERE event_id % 211 <> 17), m AS (SELECT max(seq) AS t FROM lg),
 tg AS (SELECT * FROM (SELECT unnest([t // 8, t // 4, t // 2 + 10, 3 * t // 4 + 7, t]) AS target, unnest([-1, t // 4, t // 4, 3 * t // 4, 3 * t // 4]) AS base FROM m))"""
ORACLE = {
    "l9_reconstructed": _TARGETS + " SELECT target, actor, count(*) AS n, max(seq) AS last_seq, max_by(action, seq) AS last_action, array_to_string(list_sort(list(DISTINCT resource)), ',') AS resources, any_value(base) AS base FROM tg JOIN lg ON seq <= target GROUP BY target, actor",
    "l9_report": _TARGETS + " SELECT target, any_value(base) AS base, CASE WHEN any_value(base) = target THEN 'checkpoint_seek' WHEN any_value(base) >= 0 THEN 'snapshot_then_delta' ELSE 'full_replay' END AS strategy, count(seq) AS delta, target - greatest(any_value(base) + 1, 0) + 1 - count(DISTINCT seq) AS missing FROM tg LEFT JOIN lg ON seq > base AND seq <= target GROUP BY target",
}
