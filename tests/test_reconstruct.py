"""Reconstruction equals a full replay, reads only the ranges it needs, and passes over damaged snapshots."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brinewatch.operators import reconstruct


def rows(n):
    return [(i, i * 7 % 11, ("view", "click", "error")[i * i % 3], f"res-{i * 13 % 17}") for i in range(n) if i % 37 != 5]


def replay(n, target):
    out = {}
    for seq, actor, action, resource in rows(n):
        if seq <= target:
            x = out.setdefault(actor, [0, None, None, set()])
            x[0] += 1
            x[1:3] = [seq, action]
            x[3].add(resource)
    return sorted((a, x[0], x[1], x[2], sorted(x[3])) for a, x in out.items())


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    out = reconstruct.Store(spark, str(tmp_path_factory.mktemp("store")), 50)
    out.write_ledger(spark.createDataFrame(rows(1000), "seq long, actor long, action string, resource string"))
    out.write_snapshot(200)
    out.write_snapshot(500, F.col("actor") == 3)
    out.write_snapshot(700)
    return out


def test_equal_to_a_full_replay(store):
    targets = [0, 5, 199, 200, 201, 420, 500, 640, 700, 999]
    got = {t: [] for t in targets}
    for r in store.at(targets).collect():
        got[r.target].append((r.actor, r.n, r.last_seq, r.last_action, r.resources))
    assert {t: sorted(x) for t, x in got.items()} == {t: replay(1000, t) for t in targets}


def test_damaged_snapshots_are_passed_over(store):
    assert store.sound() == [200, 700]
    assert {r.target: (r.base, r.strategy) for r in store.report([150, 200, 560, 900]).collect()} == {150: (-1, "full_replay"), 200: (200, "checkpoint_seek"), 560: (200, "snapshot_then_delta"), 900: (700, "snapshot_then_delta")}
    missing = {r.target: (r.delta, r.missing) for r in store.report([560]).collect()}
    assert missing[560] == (sum(200 < r[0] <= 560 for r in rows(1000)), sum(i % 37 == 5 for i in range(201, 561)))


def test_only_the_ranges_in_between_are_read(store):
    plan = store.ledger(700, 760)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(range" in plan and "(range#" in plan
    files = {r[0] for r in store.ledger(700, 760).select(F.input_file_name()).distinct().collect()}
    assert {f.split("range=")[1].split("/")[0] for f in files} == {"14", "15"}
