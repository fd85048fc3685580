"""Event operators against plain computations, where SQL repeats the method or can't say it."""

from __future__ import annotations

import math
import random
import statistics
import uuid

import pytest
from pyspark.sql import functions as F

from brinewatch.functions import predicates
from brinewatch.operators import attack, escalation, exposure, graphs, intake, ledger, lifetimes, posture, raw, records, windows


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src int, dst int, weight double")


def test_wide_cycles_are_found(spark):
    pairs = [(i, (i + 1) % 20) for i in range(20)] + [(5, 50), (50, 51), (51, 52), (60, 61), (61, 60), (61, 0)]
    got = {r.node: (r.component, r.size) for r in graphs.cycles(edges_of(spark, pairs)).collect()}
    assert got == {i: (0, 20) for i in range(20)} | {60: (60, 2), 61: (60, 2)}
    assert graphs.cycles(edges_of(spark, [(1, 2), (2, 3), (3, 3)])).collect() == []


def test_long_ways_are_found(spark):
    chain = edges_of(spark, [(i, i + 1) for i in range(45)])
    assert {r.node: r.cost for r in graphs.distances(chain, 0).collect()} == {i: float(i) for i in range(46)}
    short = edges_of(spark, [(i, i + 1) for i in range(30)])  # longer than the depth at which it once stopped
    assert {r.node: r.betweenness for r in exposure.betweenness(short).collect()} == {i: float(i * (30 - i)) for i in range(31)}


def test_sliding_distinct_is_a_recount(spark):
    random.seed(1)
    rows = [(i, random.randint(0, 2), random.randint(0, 60), random.choice("abcd") if i % 9 else None) for i in range(300)]
    got = {r.event_id: r.n for r in windows.sliding_distinct(spark.createDataFrame(rows, "event_id long, actor long, us long, v string"), "actor", "v", 7, "n").collect()}
    assert got == {i: len({w for _, b, u, w in rows if b == a and t - 7 <= u <= t and w is not None}) for i, a, t, _ in rows}


def test_first_in_period_is_the_greedy_walk(spark):
    random.seed(2)
    rows = [(i, random.choice(["x", "y", None]), random.randint(0, 200)) for i in range(400)]
    got = {r.event_id for r in intake.first_in_period(spark.createDataFrame(rows, "event_id long, key string, us long"), ["key"], 10).collect()}
    want, last = set(), {}
    for i, k, u in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or u - last[k] > 10:
            last[k] = u
            want.add(i)
    assert got == want


@pytest.mark.parametrize("n", (1, 2, 7, 12))
def test_every_inclusion_proof_leads_to_the_root(spark, n):
    tree = spark.createDataFrame([(i, f"{i:064x}") for i in range(n)], "i long, h string")
    root = ledger.merkle_root(tree).first().root
    for at in {0, n // 2, n - 1}:
        proof = records.inclusion_proof(tree, at).collect()
        assert records.proves(proof, f"{at:064x}", root) and (n == 1 or not records.proves(proof, f"{at + 1:064x}", root))
    with pytest.raises(ValueError, match="leaf"):
        records.inclusion_proof(tree, n)


def test_an_undamaged_chain_has_no_errors(spark):
    ev = spark.createDataFrame([(i, i % 3, 1000 - i, "view", f"r{i}") for i in range(60)], "event_id long, actor long, us long, action string, resource string")
    chain = records.chained(ev)
    assert chain.count() == 60 and records.chain_errors(chain).isEmpty()
    bad = chain.withColumn("record_hash", F.when(F.col("event_id") == 31, F.sha2("record_hash", 256)).otherwise(F.col("record_hash")))
    assert sorted(r.error for r in records.chain_errors(bad).collect()) == ["CHAIN_BROKEN", "HASH_MISMATCH"]


def test_raw_payloads_of_all_kinds(spark):
    ok = '{"source":"OKTA","event_id":"1","action":"a"}'
    two = '{"Records":[{"eventID":"2","eventName":"x","userIdentity":{"arn":"arn:1"}},{"eventID":"3","eventName":"y","userIdentity":{"userName":"u"}}]}'
    import base64
    import gzip
    import json

    nested = json.dumps({"body": json.dumps({"kinesis": {"data": base64.b64encode(ok.encode()).decode()}})})
    rows = [ok.encode(), gzip.compress(two.encode()), base64.b64encode(ok.encode()), nested.encode(), b"\x1f\x8bbroken", b"no json", None]
    df = spark.createDataFrame([(r,) for r in rows], "payload binary")
    got = sorted((r.event_id, r.envelope, r.actor) for r in raw.opened(df).where("event_id is not null").collect())
    assert got == [("1", "none", None), ("1", "none", None), ("1", "none", None), ("2", "cloudtrail", "arn:1"), ("3", "cloudtrail", "u")]
    assert raw.unreadable(df).count() == 3
    first = raw.canonical(raw.opened(df).where("event_id = '1'")).first()
    assert first.source == "okta" and first.severity == "info" and first.tags == [] and first.schema_version == "2.0"


def test_beta_quantiles(spark):
    random.seed(4)
    for a, b in ((2.0, 5.0), (40.0, 160.0), (1.0, 1.0), (700.0, 3.0)):
        draws = sorted(random.betavariate(a, b) for _ in range(40_000))
        got = spark.range(1).select(*(attack.beta_quantile(F.lit(q), F.lit(a), F.lit(b)).alias(f"q{i}") for i, q in enumerate((0.05, 0.5, 0.95)))).first()
        assert all(abs(x - draws[int(q * 40_000)]) < 0.02 for x, q in zip(got, (0.05, 0.5, 0.95), strict=True))


def test_simulated_draws_have_their_means(spark):
    r = spark.range(4000).select(attack.uniform(F.col("id"), "a").alias("u"), attack.second_of(6, F.col("id")).alias("b25"), attack.second_of(3, F.col("id")).alias("b22")).collect()
    assert abs(statistics.mean(x.u for x in r) - 0.5) < 0.02 and abs(statistics.mean(x.b25 for x in r) - 2 / 7) < 0.02 and abs(statistics.mean(x.b22 for x in r) - 0.5) < 0.02


def test_deletion_cascades(spark):
    e = edges_of(spark, [(1, 2), (2, 3), (3, 1), (4, 4)])
    nodes = spark.createDataFrame([(i,) for i in range(1, 5)], "node int")
    n, left = lifetimes.deleted(nodes, e, nodes.where("node = 2"))
    assert sorted(r.node for r in n.collect()) == [1, 3, 4] and sorted((r.src, r.dst) for r in left.collect()) == [(3, 1), (4, 4)]


def test_a_revoked_edge_revives(spark):
    rows = [(1, 10, "view"), (2, 20, "view"), (3, 30, "error"), (4, 35, "error"), (5, 40, "click")]
    df = spark.createDataFrame([(i, 7, "r", u, a) for i, u, a in rows], "event_id long, actor long, resource string, us long, action string")
    got = [tuple(r)[2:] for r in lifetimes.lives(df).orderBy("life").collect()]
    assert got == [(1, 2, 10, 20, 30), (2, 1, 40, 40, None)]
    assert [r.life for u in (25, 32, 41) for r in lifetimes.active_at(lifetimes.lives(df), F.lit(u), 100).collect()] == [1, 2]


def test_adapted_vectors_are_the_walk(spark):
    random.seed(5)
    rows = [(i, i % 2, [random.gauss(1, 1), random.gauss(0, 1)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.label: r.norm for r in posture.adapted(df, 0.1, 0.9).collect()}
    for label in (0, 1):
        mine = [v for i, k, v in rows if k == label]
        c = [statistics.mean(x) for x in zip(*mine, strict=True)]
        m = [0.0, 0.0]
        for v in mine:
            cos = 1 - sum(a * b for a, b in zip(v, c, strict=True)) / (math.hypot(*v) * math.hypot(*c))
            if round(cos, 4) <= 0.9:
                m = [0.9 * a + 0.1 * b for a, b in zip(m, v, strict=True)]
        assert abs(got[label] - math.hypot(*m)) < 1e-3


def test_policies_refuse_what_they_do_not_know():
    with pytest.raises(ValueError, match="unknown"):
        posture.typed_policy([{"name": "x", "priority": 1, "decision": "DENY", "conditions": [("a.b", "eq", 1)]}], {})
    with pytest.raises(ValueError, match="too many"):
        posture.typed_policy([{"name": "x", "priority": 1, "decision": "DENY", "conditions": []}] * 1001, {})


def test_uuid5_and_wildcards(spark):
    ns = uuid.NAMESPACE_URL
    names = ["a", "http://x.org/é", ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(predicates.uuid5(str(ns), F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(ns, n)) for n in names]
    assert spark.createDataFrame([("AN example teXt",)], "n string").select(predicates.titled(F.col("n"))).first()[0] == "An Example Text"
    assert "iam:*" in escalation.WILDCARDS


def test_trend_p_values(spark):
    # known values of Student's t: r = .5 of ten and r = .9 of five
    got = spark.createDataFrame([(0.25 * 8 / 0.75, 8.0), (0.81 * 3 / 0.19, 3.0)], "t2 double, df double").select(F.pandas_udf(attack._two_sided, "double")("t2", "df").alias("p")).collect()
    assert [round(r.p, 4) for r in got] == [0.1411, 0.0374]


def test_payloads_are_opened_once(spark):
    from brinewatch.sources.tables import events

    rows = raw.opened(raw.wrapped(events(spark, "/root/testdata/sf0.001"))).where("actor is not null")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # one closes the test's payloads, one opens them


def test_a_body_under_an_escaped_key_is_opened(spark):
    inner = '{\\"source\\":\\"app\\",\\"event_id\\":\\"7\\"}'
    rows = spark.createDataFrame([(f'{{"\\u0062ody":"{inner}"}}'.encode(),), (b"no json",), (None,), (b"[]",)], "payload binary")
    assert [(r.event_id, r.source) for r in raw.opened(rows).collect()] == [("7", "app"), (None, None)]
