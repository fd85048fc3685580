"""Decision lists: what covering learns, held against a recount of every row."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from brinewatch.llm import decision


def cells_of(rows, limits):
    names = list(limits)
    return [(1, bad, grown, tuple(sum(t <= values[n] for t in limits[n]) for n in names)) for bad, grown, values in rows]


def holds(x, values):
    return (values[x.measure] >= x.threshold) == x.above


def test_a_planted_conjunction_is_learned_and_recounted():
    random.seed(9)
    rows = []
    for i in range(3000):
        v = {"a": random.random(), "b": random.random(), "c": random.random()}
        rows.append((v["a"] >= 0.6 and v["b"] < 0.3, i % 3 > 0, v))
    limits = {n: [k / 20 for k in range(1, 20)] for n in "abc"}
    trials = decision.covering(cells_of(rows, limits), limits)
    assert {str(x) for x in trials[0].rule} == {"a >= 0.6", "b < 0.3"}
    left = rows
    for t in trials:
        hit = [r for r in left if not r[1] and all(holds(x, r[2]) for x in t.rule)]
        assert (t.bad, t.good) == (sum(r[0] for r in hit), sum(not r[0] for r in hit))
        left = [r for r in left if not all(holds(x, r[2]) for x in t.rule)]


def test_noise_gives_no_rule():
    random.seed(10)
    rows = [(random.random() < 0.2, i % 3 > 0, {"a": random.random(), "b": random.random()}) for i in range(900)]
    limits = {n: [k / 20 for k in range(1, 20)] for n in "ab"}
    assert decision.covering(cells_of(rows, limits), limits) == []


def test_a_needless_literal_is_pruned():
    random.seed(11)
    rows = [(a > 0.8, i % 3 > 0, {"a": a, "b": random.random()}) for i in range(600) for a in [random.random()]]
    limits = {"a": [0.5, 0.8000001, 0.9], "b": [0.2, 0.5]}
    assert [len(t.rule) for t in decision.covering(cells_of(rows, limits), limits)][:1] == [1]


def test_small_samples_learn_too_and_columns_may_clash(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").withColumns({c: F.lit("mine") for c in decision.ADDED})
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    trials = decision.learned(docs, labels)
    assert trials and all(t.bad >= decision.LEAST and t.bad >= decision.TRUST * (t.bad + t.good) for t in trials)
    got = decision.judged(docs, labels).join(labels, "doc_id").where("quality = 1 and not _base_failed")
    assert got.where("_kept").count() >= 0.99 * got.count()
