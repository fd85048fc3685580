"""Stateful streams: cut into micro-batches or stopped and restarted they give what one run gives, and what a plain loop gives."""

from __future__ import annotations

import datetime
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from brinewatch.streaming import flows, stateful

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def planted():
    """Events in order: (id, second, user, type, value)."""
    out = [(i, 7 * i if i % 3 else 7 * i + 1, i % 4, ("view", "error")[i % 5 == 0], float(10 + (i * i) % 17 + 100 * (i % 41 == 40))) for i in range(150)]
    return out + [(150 + i, 1200 + i, 9, "view", 1.0) for i in range(12)] + [(170, 1300, 9, "error", 99.0), (171, 5000, 2, "view", 1.0)]


def written(spark, folder, rows, name):
    df = spark.createDataFrame([(i, START + datetime.timedelta(seconds=s), u, t, v, "{}") for i, s, u, t, v in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def streamed(spark, folder, rows, parts, flow, restart=False):
    """The flow's rows over the events written in parts, one a micro-batch; with restart, the query stops after each."""
    size = -(-len(rows) // parts)
    out = f"{folder}/out"
    for k in range(parts):
        written(spark, folder, rows[k * size : (k + 1) * size], f"in/part{k}.parquet")
        if restart:
            got = stateful.run(flow(flows.source(spark, f"{folder}/in/*", "*.parquet", 1)), out)
    if not restart:
        got = stateful.run(flow(flows.source(spark, f"{folder}/in/*", "*.parquet", 1)), out)
    return sorted(tuple(r) for r in got.drop("epoch").collect())


def kept(rows, period):
    last, out = {}, []
    for i, s, u, t, _ in rows:
        if s - last.get((u, t), -math.inf) >= period:
            last[u, t] = s
            out.append((i, u, t))
    return sorted(out)


@pytest.mark.parametrize(("parts", "restart"), [(1, False), (3, False), (3, True)])
def test_first_in_period(spark, tmp_path, parts, restart):
    rows = planted()
    got = streamed(spark, tmp_path, rows, parts, lambda e: stateful.first_in_period(e, ["user_id", "event_type"], 100), restart)
    assert [r[:3] for r in got] == kept(rows, 100)


@pytest.mark.parametrize(("parts", "restart"), [(1, False), (3, True)])
def test_micro_batches(spark, tmp_path, parts, restart):
    rows = planted()
    flow = lambda e: stateful.micro_batches(e, "value > 90", size=5, seconds=60, lanes=4)
    got = streamed(spark, tmp_path, rows, parts, flow, restart)
    want, held = [], {}
    numbers = dict.fromkeys(range(4), 0)

    def close(lane, reason):
        x = held.pop(lane)
        want.append((lane, numbers[lane], len(x), reason, x[0][0], x[-1][0]))
        numbers[lane] += 1

    for i, s, u, _, v in rows:
        lane = u % 4
        if held.get(lane) and s - held[lane][0][1] >= 60:
            close(lane, "age")
        held.setdefault(lane, []).append((i, s))
        if v > 90 or len(held[lane]) >= 5:
            close(lane, "critical_priority" if v > 90 else "size")
    for lane in list(held):  # the last event's time closes what is old by then
        if held[lane] and 5000 - held[lane][0][1] >= 60:
            close(lane, "age")
    assert [(r[0], r[1], r[2], r[3], r[6], r[7]) for r in got] == sorted(want) and {r[3] for r in got} == {"age", "size", "critical_priority"}


def test_drift_before_update_and_its_hashes(spark, tmp_path):
    rows = planted()
    got = streamed(spark, tmp_path / "a", rows, 3, lambda e: stateful.drift(e, 3.0), restart=True)
    again = streamed(spark, tmp_path / "b", rows, 3, lambda e: stateful.drift(e, 3.0))
    assert got == again
    seen, want, size, last = {}, {}, -(-len(rows) // 3), {}
    for k in range(3):
        digests = {}
        for i, _, u, _, v in rows[k * size : (k + 1) * size]:
            before = seen.setdefault(u, [])
            mean = sum(before) / len(before) if before else 0
            deviation = math.sqrt(sum((x - mean) ** 2 for x in before) / len(before)) if before else 0
            score = abs(v - mean) / deviation if deviation > 1e-9 else 0.0
            want[i] = (score, score > 3 and len(before) >= 10, len(before))
            before.append(v)
            digests.setdefault(u, hashlib.sha256(last.get(u, "").encode())).update(f"{i}:{score:.6f}:{int(want[i][1])};".encode())
        last |= {u: d.hexdigest() for u, d in digests.items()}
    assert any(w[1] for w in want.values())
    for e, _, score, anomaly, n, _, _ in got:
        assert math.isclose(score, want[e][0], abs_tol=1e-9) and (anomaly, n) == want[e][1:]
    assert {r[1]: r[6] for r in sorted(got)} == last
