"""Windows cut into periods against plain loops, with a key that holds most rows, ties, null keys and gaps of many periods."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from brinewatch.functions import periods
from brinewatch.operators import posture
from brinewatch.operators.windows import sliding_distinct


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(2)
    out = [(i, draw.choice(["hot"] * 8 + ["a", None]), draw.choice([*"pqrs", None]), draw.randint(0, 400) * 5 + (50_000 if i % 50 == 0 else 0)) for i in range(600)]
    return spark.createDataFrame(out, "event_id long, key string, what string, us long").cache(), sorted(out, key=lambda r: (r[3], r[0]))


def test_sliding_distinct_and_count(rows):
    df, plain = rows
    got = {r.event_id: r.n for r in sliding_distinct(df, "key", "what", 40, "n").collect()}
    assert got == {e: len({w for _, k2, w, u2 in plain if k2 == k and us - 40 <= u2 <= us and w is not None}) for e, k, _, us in plain}
    got = {r.event_id: r.n for r in periods.sliding_count(df, ["key"], 40, "n").collect()}
    assert got == {e: sum(k2 == k and us - 40 <= u2 <= us for _, k2, _, u2 in plain) for e, k, _, us in plain}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_baselines_that_move(spark, metric):
    draw = random.Random(6)
    vectors = [(i, draw.randint(0, 2), [draw.gauss(1, 0.6) for _ in range(4)]) for i in range(90)] + [(90, None, [1.0] * 4), (91, 1, None), (92, 2, [0.0] * 4)]
    df = spark.createDataFrame(vectors, "vec_id long, label long, embedding array<double>").repartition(3)
    limits, base, want = {0: 0.9, 1: 0.4, 2: 0.4}, {}, {}
    for i, k, v in vectors:
        if k is None or v is None:
            continue
        b = base.get(k)
        d = 0.0
        if b:
            size = math.sqrt(sum(x * x for x in b)) * math.sqrt(sum(x * x for x in v))
            d = math.dist(b, v) if metric == "l2" else 1 - sum(x * y for x, y in zip(b, v, strict=True)) / size if size else 1.0
        want[i] = (pytest.approx(d, abs=1e-5), d > limits[k])
        if not b:
            base[k] = v
        elif d <= limits[k]:
            base[k] = [round(0.95 * x + 0.05 * y, 6) for x, y in zip(b, v, strict=True)]
    got = {r.vec_id: (r.distance, r.drifting) for r in posture.moving_baseline(df, limit=0.4, metric=metric, overrides={0: 0.9}).collect()}
    assert got == want and {x for _, x in want.values()} == {True, False}


def test_neighbours_and_least_before(rows):
    df, plain = rows
    x = periods.cut_up(df, 100)
    assert x.where("key = 'hot'").select("_p").distinct().count() > 20
    got = {r.event_id: (r._before and r._before.event_id, r._after and r._after.event_id) for r in periods.neighbours(x, ["key"], ["event_id"]).collect()}
    least = {r.event_id: r.m for r in periods.least_before(x, ["key"], F.when(F.col("what") == "q", F.col("us") % 97), "m").collect()}
    for key in ("hot", "a", None):
        own = [r for r in plain if r[1] == key]
        for i, (e, _, _, _) in enumerate(own):
            assert got[e] == (own[i - 1][0] if i else None, own[i + 1][0] if i + 1 < len(own) else None)
            assert least[e] == min((u % 97 for _, _, w, u in own[:i] if w == "q"), default=None)
