"""Results that must cover all of their input, beyond what the queries' SQL looks at."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from brinewatch.operators import exposure, graphs, intake, ledger
from brinewatch.operators.windows import placed
from brinewatch.plans import registry
from brinewatch.sources.tables import events

SF = "/root/testdata/sf0.001"


def brute_root(level):
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[min(i + 1, len(level) - 1)]).encode()).hexdigest() for i in range(0, len(level), 2)]
    return level[0]


@pytest.mark.parametrize("n", (1, 5, 64, 131))
def test_ledger_root_covers_every_record(spark, n):
    seqs = [i * 700 + (50_000 if i > n // 2 else 0) for i in range(n)]  # several ranges, some of them empty
    rows = [(s, s * 10, 3, "view", f"res-{s}", 1.5, f"c{s}", f"h{s}") for s in reversed(seqs)]
    names = ("seq", "us", "actor", "action", "resource", "value", "content", "record_hash")
    df = spark.createDataFrame(rows, "seq long, us long, actor long, action string, resource string, value double, content string, record_hash string")
    leaves = [hashlib.sha256(json.dumps(dict(zip(names, r, strict=True)), separators=(",", ":")).encode()).hexdigest() for r in reversed(rows)]
    got = ledger.ledger_root(df).collect()
    assert [r.root for r in got] == [brute_root(leaves)]
    last = df.withColumn("value", F.when(F.col("seq") == seqs[-1], 9.0).otherwise(F.col("value")))
    assert ledger.ledger_root(last).first().root != got[0].root


def test_the_registered_root_covers_the_last_event(spark):
    whole = registry.queries()["l3_ledger_root"](spark, SF).first().root
    short = ledger.records(events(spark, SF)).where("seq < 999")
    assert ledger.ledger_root(short).first().root != whole


def test_every_rejected_row_is_there(spark):
    counts = {r.reason: r.n for r in registry.queries()["f1_validation"](spark, SF).collect() if r.reason != "valid"}
    got = registry.queries()["s18_rejected"](spark, SF)
    assert {r.reason: r["count"] for r in got.groupBy("reason").count().collect()} == counts and max(counts.values()) > 2
    assert intake.dead_letters(placed(events(spark, SF))).join(got, ["reason", "event_id"], "left_anti").isEmpty()


def test_the_whole_graph_has_all_pairs(spark):
    pairs = {(r.c, r.s) for r in spark.sql(f"SELECT DISTINCT c_nationkey c, s_nationkey s FROM parquet.`{SF}/lineitem.parquet` JOIN parquet.`{SF}/orders.parquet` ON l_orderkey = o_orderkey JOIN parquet.`{SF}/customer.parquet` ON o_custkey = c_custkey JOIN parquet.`{SF}/supplier.parquet` ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey").collect()}
    assert {(r.src, r.dst) for r in graphs.trade(spark, SF, None).collect()} == pairs and len(pairs) > 75
    assert registry.queries()["g10_density"](spark, SF).first().edges == len(pairs)


def test_graph_queries_are_registered_on_all_pairs():
    assert graphs.SMALL and set(graphs.SMALL) <= set(registry.queries()) and not any(sql.startswith(graphs._TRADE) for sql in registry.oracle_sql().values())


def test_sampled_betweenness_stays_within_its_bound(spark):
    draw = random.Random(4)
    edges = spark.createDataFrame(sorted({(a, b) for a in range(60) for b in draw.sample(range(60), 3) if a != b}), "src long, dst long")
    exact = {r.node: r.betweenness for r in exposure.betweenness(edges).collect()}
    some = {r.node: r.betweenness for r in exposure.betweenness(edges, 30).collect()}
    n, e = 60, 0.25  # further off with a probability of 2 * exp(-2 * 30 / 16) = 0.05 each; betweenness is far below its bound in practice
    assert set(some) == set(exact) and max(abs(some[v] - exact[v]) for v in exact) < e * n * (n - 2)
    assert sum(abs(some[v] - exact[v]) for v in exact) < 0.5 * sum(exact.values())
    assert exposure.betweenness(edges, 60).orderBy("node").collect() == exposure.betweenness(edges).orderBy("node").collect()


def components(pairs):
    """Strong components of more than one node, by reach both ways."""
    ways = {}
    for a, b in pairs:
        ways.setdefault(a, set()).add(b)
    reach = {}
    for a in {x for p in pairs for x in p}:
        seen, todo = set(), [a]
        while todo:
            for b in ways.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[a] = seen
    out = {}
    for a, seen in reach.items():
        same = {b for b in seen if a in reach[b]} | {a}
        if len(same) > 1:
            out[a] = (min(same), len(same))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_cycles_of_graphs_with_chains_and_rings(spark, seed):
    draw = random.Random(seed)
    pairs = {(draw.randint(0, 15), draw.randint(0, 15)) for _ in range(14 + 3 * seed)}
    for k, n in enumerate((1, 2, 5, 9)):  # chains between nodes, from one to itself, into nothing; rings
        a, b = draw.randint(0, 15), draw.choice([draw.randint(0, 15), 900 + k])
        way = [a, *range(100 + 20 * k, 100 + 20 * k + n), b if k % 2 else a]
        pairs |= set(zip(way, way[1:], strict=False))
        ring = [*range(300 + 20 * k, 302 + 20 * k + n)]
        pairs |= set(zip(ring, [*ring[1:], ring[0]], strict=True))
    got = {r.node: (r.component, r["size"]) for r in graphs.cycles(spark.createDataFrame(sorted(pairs), "src long, dst long")).collect()}
    assert got == components({p for p in pairs if p[0] != p[1]})


def test_a_chain_of_a_hundred_thousand_nodes(spark, monkeypatch):
    rounds = []
    cut = graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: (rounds.append(1), cut(df))[1])
    n = 100_000
    line = spark.range(n).selectExpr("id AS src", "id + 1 AS dst")
    ring = spark.range(n).selectExpr(f"id + {2 * n} AS src", f"(id + 1) % {n} + {2 * n} AS dst")
    got = graphs.cycles(line.unionAll(ring)).groupBy("component", "size").agg(F.count("*").alias("n")).collect()
    assert [tuple(r) for r in got] == [(2 * n, n, n)] and len(rounds) < 90  # two tables a round, 18 rounds each way


def chain(spark, seqs):
    return ledger.records(spark.createDataFrame([(s, s, 1, "view", "r", 1, 1.0) for s in seqs], "event_id long, us long, actor long, action string, resource string, k long, value double"))


def test_gaps_of_whole_ranges_are_found(spark):
    df = chain(spark, [9_998, 9_999, 35_000, 35_001, 70_000])
    assert sorted(map(tuple, ledger.gaps(df).collect())) == [(10_000, 34_999), (35_002, 69_999)]
    assert sorted(r.seq for r in ledger.verified(df).where("error = 'SEQUENCE_GAP'").collect()) == [35_000, 70_000]


def test_falls_in_time_between_ranges_are_found(spark):
    rows = [(i, u, 1, "view", 1.0) for i, u in ((9_998, 5), (9_999, 9), (10_000, 7), (10_001, 8), (40_000, 3))]
    got = {r.invariant: r.violations for r in intake.invariants(spark.createDataFrame(rows, "event_id long, us long, actor long, action string, value double")).collect()}
    assert got["monotonic"] == 2
