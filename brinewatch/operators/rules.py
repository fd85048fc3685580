"""Threshold rules over drift, policy files of a folder, and role hierarchies checked for cycles (Q6, S14, G3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from brinewatch.operators import baselines, graphs
from brinewatch.operators.posture import kept
from brinewatch.sources.tables import EV, cut, events

#: Severities in order.
SEVERITIES = ("none", "low", "medium", "high", "critical")


@dataclass(frozen=True)
class Rule:
    """condition is one of CONDITIONS; a lower priority goes first, equal ones by id."""

    rule_id: str
    priority: int
    condition: str
    threshold: float
    decision: str
    mitigations: tuple[str, ...] = ()
    enabled: bool = True


CONDITIONS = {
    "drift_score_above": lambda t: F.col("score") > t,
    "drift_score_below": lambda t: F.col("score") < t,
    "severity_gte": lambda t: F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")) - 1 >= int(t),
    "anomalous_dim_count": lambda t: F.col("anomalous") >= int(t),
    "anomaly_ratio_above": lambda t: F.col("ratio") > t,
    "insufficient_baseline": lambda t: F.col("unsure"),
    "always": lambda t: F.lit(True),
}


def checked(rules: list[Rule]) -> list[Rule]:
    """Rules in the order they are asked; unknown conditions, repeated or empty ids and negative priorities are errors."""
    if any(not r.rule_id or r.priority < 0 or r.condition not in CONDITIONS for r in rules) or len({r.rule_id for r in rules}) < len(rules):
        raise ValueError("a rule without an id or with a known one, a negative priority or an unknown condition")
    return sorted((r for r in rules if r.enabled), key=lambda r: (r.priority, r.rule_id))


def evaluated(contexts: DataFrame, rules: list[Rule]) -> DataFrame:
    """contexts(score, severity, anomalous, ratio, unsure, ...) with the first rule that holds, its decision and mitigations; allow, without a rule, where none does."""
    name, decision, what = F.lit(None).cast("string"), F.lit("allow"), F.lit("")
    for r in reversed(checked(rules)):
        holds: Column = F.coalesce(CONDITIONS[r.condition](r.threshold), F.lit(False))
        name, decision, what = F.when(holds, r.rule_id).otherwise(name), F.when(holds, r.decision).otherwise(decision), F.when(holds, ",".join(r.mitigations)).otherwise(what)
    return contexts.withColumns({"rule": name, "decision": decision, "mitigations": what})


def contexts(ev: DataFrame, limit: float = 2.5, dimension: float = 1.5) -> DataFrame:
    """Each event against its actor's earlier ones: the length of its z-scores, its severity, how many features are beyond a limit and their share, and whether there are under ten earlier events."""
    w = W.partitionBy("actor", "feature").orderBy("us", "event_id").rowsBetween(W.unboundedPreceding, -1)
    x = baselines.long_form(ev).select("actor", "event_id", "x", F.count("x").over(w).alias("n"), F.avg("x").over(w).alias("m"), F.stddev_pop("x").over(w).alias("s")).where("n > 0")
    z = x.withColumn("z", F.round(baselines.zscore(F.col("x"), F.col("m"), F.col("s")), 6))
    a = z.groupBy("actor", "event_id").agg(F.min("n").alias("n"), F.round(F.sqrt(F.sum(F.col("z") * F.col("z"))), 5).alias("score"), F.count(F.when(F.abs("z") > dimension, 1)).alias("anomalous"), F.count("*").alias("dims"))
    return a.select("actor", "event_id", "score", baselines.ladder(F.col("score"), limit).alias("severity"), "anomalous", (F.col("anomalous") / F.col("dims")).alias("ratio"), (F.col("n") < 10).alias("unsure"))


RULES = [
    Rule("new", 1, "insufficient_baseline", 0, "review", ("log_only",)), Rule("wide", 2, "anomalous_dim_count", 2, "quarantine", ("quarantine_traffic", "alert_soc")), Rule("severe", 3, "severity_gte", 3, "deny", ("revoke_session", "force_mfa")),
    Rule("off", 0, "always", 0, "deny", enabled=False), Rule("far", 4, "drift_score_above", 2.2, "review", ("alert_soc",)), Rule("some", 5, "anomaly_ratio_above", 0.3, "review", ("rate_limit",)), Rule("quiet", 6, "drift_score_below", 1.0, "allow", ("log_only",)),
]


def written_policies(ev: DataFrame) -> str:
    """A folder of policy files made from the events: one policy a resource, with a condition for each action seen on it; a file an action's first resources, every seventeenth line cut off."""
    a = ev.groupBy("k").agg(F.array_sort(F.collect_set("action")).alias("actions"), F.round(F.max("value"), 2).alias("top"))
    conditions = F.transform("actions", lambda x: F.struct(F.lit("action").alias("field"), F.lit("eq").alias("op"), x.alias("value")))
    line = F.to_json(F.struct(F.concat(F.lit("res-"), F.col("k").cast("string")).alias("name"), (F.col("k") % 10).alias("priority"), conditions.alias("conditions"), F.when(F.col("k") % 5 == 0, F.lit(False)).alias("enabled")))
    return kept(a.select(F.when(F.col("k") % 17 == 3, F.substring(line, 1, 20)).otherwise(line).alias("value"), (F.col("k") % 4).alias("set")), "policies", "text", ["set"])


def loaded_policies(spark: SparkSession, folder: str) -> DataFrame:
    """(name, priority, conditions, enabled, checksum, error) from all policy files below a folder, a JSON policy a line. A line that can't be read, or lacks a name, is recorded as an error; the others load."""
    raw = spark.read.option("recursiveFileLookup", "true").text(folder)
    p = F.from_json("value", "name string, priority int, conditions array<struct<field string, op string, value string>>, enabled boolean")
    ok = F.try_parse_json("value").isNotNull() & p["name"].isNotNull()
    return raw.select(F.when(ok, p["name"]).alias("name"), F.when(ok, F.coalesce(p["priority"], F.lit(100))).alias("priority"), F.when(ok, F.size(F.coalesce(p["conditions"], F.array()))).alias("conditions"), F.when(ok, F.coalesce(p["enabled"], F.lit(True))).alias("enabled"), F.substring(F.sha2("value", 256), 1, 12).alias("checksum"), F.when(~ok, F.lit("unreadable")).alias("error"))


def hierarchy(ev: DataFrame) -> DataFrame:
    """(src, dst): roles and what they inherit from, made from the events' resources: k from k / 2 and k / 3; and, wrongly, k / 4 from k where a purchase of over 300 was seen."""
    k = ev.groupBy("k").agg(F.max(F.when(F.col("action") == "purchase", F.col("value"))).alias("top"))
    half, third = (k.select(F.col("k").alias("src"), F.expr(f"k div {n}").alias("dst")) for n in (2, 3))
    wrong = k.where("top > 300 and k >= 4").select(F.expr("k div 4").alias("src"), F.col("k").alias("dst"))
    return half.unionAll(third).unionAll(wrong).where("src >= 1 and dst >= 1 and src != dst").distinct()


def inherited(edges: DataFrame) -> DataFrame:
    """(role, inherits, hops): all that roles inherit, transitively. Edges within a cycle are refused, all of them, so that no order of insertion decides and no privilege is inflated."""
    edges = cut(edges)
    ring = graphs.cycles(edges).select("node", "component")
    of = lambda end: ring.select(F.col("node").alias(end), F.col("component").alias(f"{end}_ring"))
    sound = edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left").where("src_ring is null or dst_ring is null or src_ring != dst_ring").select("src", "dst")
    return graphs.reach(cut(sound), 1 << 20).select(F.col("root").alias("role"), F.col("node").alias("inherits"), "hops")


QUERIES = {
    "q6_threshold_rules": lambda s, d: evaluated(contexts(events(s, d)), RULES),
    "s14_policies": lambda s, d: loaded_policies(s, written_policies(events(s, d))),
    "g3_inherited": lambda s, d: inherited(hierarchy(events(s, d))),
}
_PRIOR = "OVER (PARTITION BY actor, feature ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ORACLE = {
    "q6_threshold_rules": baselines._LONG + f""", p AS (SELECT actor, event_id, x, count(x) {_PRIOR} AS n, avg(x) {_PRIOR} AS m, stddev_pop(x) {_PRIOR} AS s FROM lf), z AS (SELECT *, round(CASE WHEN s < 1e-9 THEN 0 ELSE (x - m) / s END, 6) AS z FROM p WHERE n > 0),
 a AS (SELECT actor, event_id, min(n) AS n, round(sqrt(sum(z * z)), 5) AS score, count(*) FILTER (abs(z) > 1.5) AS anomalous, count(*) AS dims FROM z GROUP BY ALL),
 c AS (SELECT actor, event_id, score, CASE WHEN score <= 1.25 THEN 'none' WHEN score <= 2 THEN 'low' WHEN score <= 2.5 THEN 'medium' WHEN score <= 3.75 THEN 'high' ELSE 'critical' END AS severity, anomalous, anomalous / dims AS ratio, n < 10 AS unsure FROM a),
 r AS (SELECT *, CASE WHEN unsure THEN 'new' WHEN anomalous >= 2 THEN 'wide' WHEN severity IN ('high', 'critical') THEN 'severe' WHEN score > 2.2 THEN 'far' WHEN ratio > 0.3 THEN 'some' WHEN score < 1.0 THEN 'quiet' END AS rule FROM c)
 SELECT *, CASE rule WHEN 'new' THEN 'review' WHEN 'wide' THEN 'quarantine' WHEN 'severe' THEN 'deny' WHEN 'far' THEN 'review' WHEN 'some' THEN 'review' ELSE 'allow' END AS decision, CASE rule WHEN 'new' THEN 'log_only' WHEN 'wide' THEN 'quarantine_traffic,alert_soc' WHEN 'severe' THEN 'revoke_session,force_mfa' WHEN 'far' THEN 'alert_soc' WHEN 'some' THEN 'rate_limit' WHEN 'quiet' THEN 'log_only' ELSE '' END AS mitigations FROM r""",
    "s14_policies": EV + """, a AS (SELECT k, list_sort(list(DISTINCT action)) AS acts FROM ev GROUP BY k),
 l AS (SELECT *, '{"name":"res-' || k || '","priority":' || k % 10 || ',"conditions":[' || array_to_string(list_transform(acts, lambda x: '{"field":"action","op":"eq","value":"' || x || '"}'), ',') || ']' || CASE WHEN k % 5 = 0 THEN ',"enabled":false' ELSE '' END || '}' AS line FROM a), v AS (SELECT *, k % 17 <> 3 AS ok, CASE WHEN k % 17 = 3 THEN substr(line, 1, 20) ELSE line END AS value FROM l)
 SELECT CASE WHEN ok THEN 'res-' || k END AS name, CASE WHEN ok THEN (k % 10)::INT END AS priority, CASE WHEN ok THEN len(acts)::INT END AS conditions, CASE WHEN ok THEN k % 5 <> 0 END AS enabled, substr(sha256(value), 1, 12) AS checksum, CASE WHEN NOT ok THEN 'unreadable' END AS error FROM v""",
    "g3_inherited": EV.replace("WITH ev", "WITH RECURSIVE ev") + """, ks AS (SELECT k, max(value) FILTER (action = 'purchase') AS top FROM ev GROUP BY k),
 e AS (SELECT DISTINCT src, dst FROM (SELECT k AS src, k // 2 AS dst FROM ks UNION ALL SELECT k, k // 3 FROM ks UNION ALL SELECT k // 4, k FROM ks WHERE top > 300 AND k >= 4) WHERE src >= 1 AND dst >= 1 AND src <> dst),
 cl AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM cl JOIN e ON b = src), sd AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM cl WHERE a = dst AND b = src)),
 rr AS (SELECT src AS role, dst AS inherits, 1::BIGINT AS h FROM sd UNION SELECT role, dst, h + 1 FROM rr JOIN sd ON inherits = src) SELECT role, inherits, min(h) AS hops FROM rr GROUP BY ALL""",
}
