"""Payloads of state events are parsed once, however many changes read their fields."""

from __future__ import annotations

from brinewatch.operators import states


def test_a_payload_is_parsed_once(spark):
    raw = spark.createDataFrame([(1, '{"event_type": "login", "actor": "a", "timestamp": "5"}'), (2, None), (3, "{}")], "seq long, payload string")
    found = states.changes(raw)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.count("jsontostructs") == 1
    assert {r.seq for r in found.collect()} == {1} and sorted(r.seq for r in states.parsed(raw).collect()) == [1, 2, 3]
