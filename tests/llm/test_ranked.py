"""The search against a plain ranking of all documents."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from brinewatch.llm import ranked

from conftest import A

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, queries, k):
    """docs and queries: rows (id, text); a query's rows are one."""
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [x for x in held if x[1]]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    asked = collections.defaultdict(set)
    for i, t in queries:
        asked[i] |= set(terms(t))
    out = []
    for q, ts in asked.items():
        scores = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return out


def found(spark, docs, queries, k):
    out = ranked.search(ranked.build(docs), queries, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return [tuple(r) for r in out.collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_awkward_rows_equal_a_plain_ranking(spark, awkward, k):
    asks = [(1, "The FOX of one élan"), (2, None), (3, ""), (4, "- ..."), (5, "nowhere"), (6, "two"), (6, "W5x3 dog"), (None, "fox"), (7, "the " * 500)]
    queries = spark.createDataFrame(asks, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert ordered(found(spark, awkward.withColumn("score", ranked.F.lit(1)).withColumn("query", ranked.F.lit("x")), queries, k)) == ordered(plain(rows, asks, k))


def test_many_documents_ties_and_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ranked, "GROUP", 40)
    monkeypatch.setattr(ranked, "BLOCK", 2000)
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "été", "x9"]
    docs = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(0, 60)))) for i in range(300)] + [(1000 + i, A) for i in range(100)]
    asks = [(i, " ".join(draw.choices(vocabulary, k=8))) for i in range(20)] + [(30, A)]
    got = found(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(asks, "item_id long, text string"), 50)
    assert ordered(got) == ordered(plain(docs, asks, 50))


def test_words_as_query_ids(spark):
    docs, asks = [(1, "red fish"), (2, "blue fish")], [("a", "blue"), ("b", "fish"), (None, "red")]
    assert ordered(found(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asks, "item_id string, text string"), 5)) == ordered(plain(docs, asks, 5))


def test_empty_tables(spark, awkward, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(spark, awkward, none, 5) == []
    assert found(spark, nothing, spark.createDataFrame([(1, "fox")], "item_id long, text string"), 5) == []


def test_bytes_bound_impacts():
    draw = np.random.default_rng(1)
    tf, norm = draw.integers(1, 10_000, 100_000), draw.integers(50, 100_000, 100_000)
    exact = ranked.impacts(tf, norm)
    level = -(-exact // ranked.STEP)
    assert level.max() <= 255 and (level * ranked.STEP >= exact).all() and ((level - (level > 0)) * ranked.STEP + (level > 0) <= exact).all()


def test_term_counts():
    texts = ["", None, "a", "a b", " a ", "É-é x9", "..", "a" * 300_000, "x", "y z"]
    assert ranked.lengths(pa.array(texts)).tolist() == [len(terms(t)) for t in texts]
    assert ranked.lengths(pa.array(texts).slice(2, 4)).tolist() == [len(terms(t)) for t in texts[2:6]]
