"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math

import duckdb
import pytest

from brinewatch.operators import graphs
from brinewatch.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        if x is None or isinstance(x, str | bool):
            return x
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6) + 0.0
        return x

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


#: Graph queries run on a fixture of few edges here, these also on all pairs of nations, as registered.
WHOLE = ["t1_reach", "t5_paths", "r14_noisy_or", "t17_cycles", "t16_betweenness", "r6_node_risk"]
NAMES = sorted(registry.oracle_sql()) + [f"{n} whole" for n in WHOLE]


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, db, name):
    name, _, whole = name.partition(" ")
    small = name in graphs.SMALL and not whole
    got = (graphs.SMALL if small else registry.queries())[name](spark, SF)
    want = db.execute((registry.small_sql() if small else registry.oracle_sql())[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(names, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(math.isclose(v, w, rel_tol=1e-9, abs_tol=2e-6) if isinstance(v, float) and isinstance(w, float) else v == w for v, w in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).collect() is not None
