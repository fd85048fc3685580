"""Threshold rules one by one, and hierarchies with cycles."""

from __future__ import annotations

import pytest

from brinewatch.operators import rules


@pytest.mark.parametrize(
    ("condition", "threshold", "held"),
    [("drift_score_above", 2.0, {2, 3}), ("drift_score_below", 2.0, {0}), ("severity_gte", 3, {2, 3}), ("anomalous_dim_count", 2, {3}), ("anomaly_ratio_above", 0.5, {3}), ("insufficient_baseline", 0, {0}), ("always", 0, {0, 1, 2, 3, 4})],
)
def test_conditions(spark, condition, threshold, held):
    rows = [(0, 1.0, "none", 0, 0.0, True), (1, 2.0, "low", 1, 0.3, False), (2, 2.1, "high", 1, 0.5, False), (3, 9.0, "critical", 3, 1.0, False), (4, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, score double, severity string, anomalous long, ratio double, unsure boolean")
    got = {r.id: (r.rule, r.decision) for r in rules.evaluated(df, [rules.Rule("r", 1, condition, threshold, "deny")]).collect()}
    assert got == {i: ("r", "deny") if i in held else (None, "allow") for i in range(5)}


def test_order_and_errors(spark):
    df = spark.createDataFrame([(1.0,)], "score double")
    listed = [rules.Rule("b", 2, "always", 0, "deny"), rules.Rule("z", 1, "always", 0, "review", ("x", "y")), rules.Rule("a", 0, "always", 0, "deny", enabled=False), rules.Rule("zz", 1, "always", 0, "deny")]
    r = rules.evaluated(df, listed).first()
    assert (r.rule, r.decision, r.mitigations) == ("z", "review", "x,y")
    for bad in (rules.Rule("", 1, "always", 0, "deny"), rules.Rule("x", -1, "always", 0, "deny"), rules.Rule("x", 1, "sometimes", 0, "deny"), listed[0]):
        with pytest.raises(ValueError, match="a rule"):
            rules.checked([*listed, bad])


def test_edges_within_a_cycle_are_refused(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (0, 1)], "src long, dst long")
    assert sorted(tuple(r) for r in rules.inherited(edges).collect()) == [(0, 1, 1), (3, 4, 1), (3, 5, 2), (4, 5, 1)]
