from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from brinewatch.llm import near
from brinewatch.llm.components import components
from brinewatch.llm.near import least_shared, near_groups, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width, num, den):
    """Component and set size of each row with an id, by comparing all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                up[max(find(x), find(y))] = min(find(x), find(y))
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least.get(find(x), i), i)
    return sorted((i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets))


def test_random_near_copies_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)  # several block pairs
    random.seed(5)
    words = [f"w{i}" for i in range(300)]
    base = [[random.choice(words) for _ in range(n)] for n in (3, 5, 20, 60, 120, 400)]
    rows = []
    for i in range(260):
        t = list(random.choice(base))
        for _ in range(random.randint(0, max(1, len(t) // 25))):
            t[random.randrange(len(t))] = random.choice(words)
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, threshold, num, den in ((3, 0.85, 85, 100), (5, 0.8, 4, 5)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_groups(df, width, threshold).collect())
        assert got == brute(rows, width, num, den)


def test_awkward_rows(spark, awkward, nothing):
    got = near_groups(awkward, 3, 0.85).collect()
    assert len(got) == awkward.count()
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute(rows, 3, 85, 100)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert near_groups(nothing).collect() == []


def test_one_id_with_two_texts(spark):
    rows = [(1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (3, "a b c d")]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1)}


def test_shingle_sets_count_exactly():
    texts = ["", "a", "A b", "a b c a b c", "x " * 5000, None, "é É é"]
    got = [len(s) for s in shingle_sets(pa.array(texts), 3)]
    assert got == [len(shingles(t, 3)) for t in texts]
    assert all(np.all(np.diff(s.astype(object)) > 0) for s in shingle_sets(pa.array(texts), 3) if len(s) > 1)


def test_least_shared_bounds_the_odds():
    assert least_shared(64, 0.85) >= 30
    assert least_shared(1, 0.85) == 0


def test_components_of_a_chain(spark):
    edges = spark.range(60).selectExpr("id + 1 as a", "id as b").unionAll(spark.createDataFrame([(100, 101), (103, 102), (102, 101)], "a long, b long"))
    got = {r.node: r.component for r in components(edges, "chain").collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 104)} == {100}
