"""Mixing against a plain computation of weights, passes, permutations and offsets, and its awkward rows."""

from __future__ import annotations

import collections
import math
import random

from pyspark.sql import functions as F

from brinewatch.llm import mixing


def hashes(spark, rows, schema, *columns):
    """Spark's hash of each row's columns, seed first."""
    df = spark.createDataFrame(rows, schema)
    return {tuple(r)[:-1]: r.h for r in df.withColumn("h", F.xxhash64(*columns)).collect()}


def brute_exponent(shares, limit):
    """The least exponent in 0 .. 1 at which no source is passed through more often than limit times the least repeated one."""
    lo, hi = 0.0, 1.0
    for _ in range(60):
        a = (lo + hi) / 2
        r = [p ** (a - 1) for p in shares]
        lo, hi = (a, hi) if max(r) > limit * min(r) else (lo, a)
    return hi


def test_offsets_and_copies_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    monkeypatch.setattr(mixing, "HEAP", 4)
    random.seed(3)
    rows = [(i, f"s{0 if i < 900 else 1 if i < 1150 else 2}", "w " * random.randint(0, 30)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    seed, limit = 17, 2.5
    got = mixing.mixed(docs, repetition=limit, seed=seed).collect()

    deal = {k[0]: h for k, h in hashes(spark, [(i, t, seed) for i, _, t in rows], "doc_id long, text string, s int", "s", "doc_id", "text").items()}
    size = {i: len(t.split()) + 1 for i, _, t in rows}
    of = collections.defaultdict(list)
    for i, s, _ in rows:
        of[s].append(i)
    total = {s: sum(size[i] for i in ids) for s, ids in of.items()}
    whole = sum(total.values())
    a = brute_exponent([t / whole for t in total.values()], limit)
    z = sum((t / whole) ** a for t in total.values())
    weight = {s: (t / whole) ** a / z for s, t in total.items()}
    assert all(math.isclose(r._weight, weight[r.source], rel_tol=1e-6) for r in got)
    budget = max(total[s] / weight[s] for s in total)

    blocks = {s: math.ceil(len(ids) / 16) for s, ids in of.items()}
    pairs = [(s, b) for s in of for b in range(max(blocks.values()) + 1)]
    order = {k[:2]: h for k, h in hashes(spark, [(s, b, seed + 1) for s, b in pairs], "s string, b long, n int", "n", "b", "s").items()}
    heap = {k[0]: h for k, h in hashes(spark, [(b, seed + 3) for _, b in pairs[: max(blocks.values()) + 1]], "b long, n int", "n", "b").items()}
    inner = {k[0]: h for k, h in hashes(spark, [(d, seed + 2) for d in deal.values()], "d long, n int", "d", "n").items()}
    want = collections.Counter()
    for s, ids in of.items():
        place = lambda i: (lambda b: (order[s, heap[b] % math.ceil(blocks[s] / 4)], heap[b] % math.ceil(blocks[s] / 4), order[s, b], b, inner[deal[i]], deal[i]))(deal[i] % blocks[s])  # noqa: B023, E731
        passes, at = weight[s] * budget / total[s], 0
        for i in sorted(ids, key=place):
            n = math.floor(passes + 1e-6) + (at < (passes - math.floor(passes + 1e-6)) * total[s] - 1e-3)
            want.update((i, c, at) for c in range(n))
            at += size[i]
    assert collections.Counter((r.doc_id, r._copy, r._offset) for r in got) == want


def test_rows_without_ids_are_split_and_columns_may_clash(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 64)
    rows = [(None, None, None, "a", "b", "c")] * 2000 + [(i, "s", "x y", "a", "b", "c") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _total string, _copy string, `a.b` string")
    got = mixing.mixed(docs, repetition=1.0)
    assert got.columns == ["doc_id", "source", "text", "_total", "a.b", *mixing.ADDED] and got.count() == 2050
    offsets = [r._offset for r in got.where("doc_id is null").select("_offset").collect()]
    assert sorted(offsets) == list(range(2000))  # one token each, none on top of another


def test_an_empty_table_gives_an_empty_table(spark, nothing):
    assert mixing.mixed(nothing).collect() == []
