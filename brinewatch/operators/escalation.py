"""Privilege escalation and chains: what assumed roles are, what they lead to over trust between roles, and how fast.

Purchases stand for assumed roles. Role k trusts role k / 2, and every 33rd one trusts role 2k + 1, so that there are chains and cycles. A role's way to
the roles of high privilege is worked out once a role, level by level, and joined to the events.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brinewatch.functions.predicates import in_cidr
from brinewatch.operators import graphs
from brinewatch.operators.windows import PLACED, in_order, placed, trailing
from brinewatch.sources.tables import DAY, HOUR, cut, events

__all__ = ["alerts", "in_cidr", "joined", "privilege_chain", "privilege_escalation"]

# What names of roles of high privilege hold, and which granted policies are wildcards.
HIGH_PRIVILEGE = r"(?i)(admin|root|owner|superuser|full.?access|power.?user|god.?mode|break.?glass)"
WILDCARDS = ("iam:*", "*:*", "s3:*", "ec2:*")
DEPTH = 8


def alerts(rows: DataFrame, detector: str, subtype: str, severity: str | Column, subject: str | Column) -> DataFrame:
    severity, subject = (F.lit(severity) if isinstance(severity, str) else severity), (F.col(subject) if isinstance(subject, str) else subject)
    return rows.select(F.lit(detector).alias("detector"), F.lit(subtype).alias("subtype"), "actor", subject.cast("string").alias("subject"), "event_id", severity.alias("severity"))


def all_alerts(rows: DataFrame, detector: str, subject: str, rules: list[tuple[Column, str, str]]) -> DataFrame:
    """The alerts of many rules (condition, subtype, severity) about one subject, in one pass over the rows."""
    hits = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(t).alias("subtype"), F.lit(v).alias("severity"))) for c, t, v in rules)))
    x = rows.select("actor", F.col(subject).cast("string").alias("subject"), "event_id", F.inline(hits))
    return x.select(F.lit(detector).alias("detector"), "subtype", "actor", "subject", "event_id", "severity")


def joined(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, found)


def trust(ev: DataFrame) -> DataFrame:
    """(src, dst) of roles, by number."""
    roles = ev.select("k").where("k is not null").distinct()
    down = roles.where("k >= 1").select(F.col("k").alias("src"), F.floor(F.col("k") / 2).alias("dst"))
    up = roles.where("k % 33 = 0").select(F.col("k").alias("src"), (2 * F.col("k") + 1).alias("dst")).join(roles.withColumnRenamed("k", "dst"), "dst", "left_semi")
    return down.unionByName(up).where("src != dst").distinct()


def ways_up(ev: DataFrame) -> DataFrame:
    """(k, nearest, hops, far, cyclic) for each role: the nearest role of high privilege (itself counts) and its hops, the hops of the farthest, and whether it is on a cycle of trust."""
    edges = cut(trust(ev))
    roles = ev.select("k").where("k is not null").distinct()
    own = roles.select("k", F.col("k").alias("node"), F.lit(0).cast("bigint").alias("hops"))
    back, high = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roles.where("k % 10 = 0").select(F.col("k").alias("root"))
    led = graphs.reach(back, DEPTH, high).select(F.col("node").alias("k"), F.col("root").alias("node"), "hops")  # backwards: only from roles of high privilege
    up = own.unionByName(led).where("node % 10 = 0").groupBy("k").agg(F.min(F.struct("hops", "node")).alias("a"), F.max("hops").alias("far"))
    on = graphs.cycles(edges).select(F.col("node").alias("k"), F.lit(True).alias("cyclic"))
    found = roles.join(up, "k", "left").join(on, "k", "left")
    return cut(found.select("k", F.col("a.node").alias("nearest"), F.col("a.hops").alias("hops"), "far", F.coalesce("cyclic", F.lit(False)).alias("cyclic")))


def assumed(ev: DataFrame) -> DataFrame:
    """Assumed roles with the account they lie in and the policies that come with them."""
    policies = F.array_compact(F.array(F.when(F.col("event_id") % 13 == 0, F.lit("iam:*")), F.when(F.col("event_id") % 17 == 0, F.lit("s3:get"))))
    there = F.concat(F.lit("acc"), ((F.col("k") + F.col("actor")) % 7).cast("string"))
    return ev.where("action = 'purchase'").select("event_id", "actor", "us", "k", "role", "account", there.alias("role_account"), policies.alias("policies"), "value")


def privilege_escalation(ev: DataFrame, ways: DataFrame | None = None) -> DataFrame:
    """Roles of high privilege assumed directly or in another account, roles that lead to one, and wildcard policies."""
    x = assumed(ev)
    high = x.where(F.col("role").rlike(HIGH_PRIVILEGE))
    led = x.join(ways or ways_up(ev), "k").where("hops is not null")
    wild = x.select("event_id", "actor", "role", F.explode("policies").alias("policy")).where(F.col("policy").isin(*WILDCARDS))
    return joined(
        alerts(high, "escalation", "direct_high_priv_assumption", "critical", "role"), alerts(led, "escalation", "graph_path_escalation", F.when(F.col("hops") + 1 <= 2, "critical").otherwise("high"), "role"),
        alerts(high.where("account != role_account"), "escalation", "cross_account_escalation", "critical", "role"), alerts(wild, "escalation", "wildcard_policy_abuse", "high", "role"),
    )


def privilege_chain(ev: DataFrame, ways: DataFrame | None = None, us: int = 3 * DAY) -> DataFrame:
    """Long chains to a role of high privilege (an actor, its role, and so on: five nodes, critical from seven), roles on a cycle, roles of high privilege
    that at least four actors come nearest to, and chains at least twice as long as any of the actor's in the window before, two at least."""
    x = assumed(ev).join(ways or ways_up(ev), "k").where("hops is not null").withColumn("nodes", F.col("far") + 2)
    many = x.groupBy("nearest").agg(F.countDistinct("actor").alias("actors")).where("actors >= 4").select("nearest")
    w = W.partitionBy("actor").orderBy("us").rangeBetween(-us, -1)
    y = x.withColumns({"old": F.max("nodes").over(w), "seen": F.count("*").over(w)})
    return joined(
        alerts(x.where("nodes >= 5"), "chain", "deep_escalation_chain", F.when(F.col("nodes") >= 7, "critical").otherwise("high"), "role"), alerts(x.where("cyclic"), "chain", "circular_role_chain", "high", "role"),
        alerts(x.join(many, "nearest", "left_semi"), "chain", "converging_chains", "high", "nearest"), alerts(y.where("seen >= 2 and nodes >= 2 * old"), "chain", "chain_acceleration", "high", "role"),
    )


def escalation_events(ev: DataFrame) -> DataFrame:
    """By event: a role of high privilege, one that such a role trusts at most two hops away, the third assumed role of the window, an error (a lost factor) within half a day before,
    a spree of three signups (policies), and a value of 200 or more in assumed roles, in three days."""
    day3 = 3 * DAY
    x = assumed(ev).join(ways_up(ev).select("k", "hops"), "k", "left")
    x = x.withColumns({"n": F.count("*").over(trailing(day3)), "total": F.sum("value").over(trailing(day3))})
    lost = F.max(F.when(F.col("action") == "error", F.col("us"))).over(in_order().rowsBetween(W.unboundedPreceding, -1))
    signs = F.count(F.when(F.col("action") == "signup", 1)).over(trailing(day3))
    y = ev.select("event_id", "actor", "us", "action", "role").withColumns({"lost": lost, "signs": signs})
    return joined(
        alerts(x.where("hops = 0"), "graph_escalation", "direct_escalation", "critical", "role"), alerts(x.where("hops between 1 and 2"), "graph_escalation", "path_escalation", "critical", "role"),
        alerts(x.where("n >= 3"), "graph_escalation", "repeated_escalation", "high", "role"), alerts(y.where(f"action = 'purchase' and us - lost <= {12 * HOUR}"), "graph_escalation", "factor_lost_before", "critical", "role"),
        alerts(y.where("action = 'signup' and signs >= 3"), "graph_escalation", "policy_spree", "high", "role"), alerts(x.where("total >= 200"), "graph_escalation", "cumulative_escalation", "high", "role"),
    )


def graph_movement(ev: DataFrame) -> DataFrame:
    """Each actor's movement over roles: chain of at least four nodes, a pivot to a role of high privilege over others, a rise of privilege by five or more between two assumed
    roles, a service account in a human role, more than one account."""
    x = assumed(ev).join(ways_up(ev), "k", "left").withColumn("rise", F.col("k") % 10 - F.lag(F.col("k") % 10).over(in_order()))
    a = x.groupBy("actor").agg(F.max(F.col("far") + 2).alias("nodes"), F.max(F.when(F.col("hops") >= 1, 1).otherwise(0)).alias("pivot"), F.max("rise").alias("rise"), F.countDistinct("account").alias("accounts"), F.max(F.when(~F.col("role").startswith("svc-"), 1).otherwise(0)).alias("human"))
    flags = F.array_compact(F.array(F.when(F.col("nodes") >= 4, F.lit("hop_chain")), F.when(F.col("pivot") == 1, F.lit("high_value_pivot")), F.when(F.col("rise") >= 5, F.lit("privilege_pivot")), F.when((F.col("actor") % 7 == 0) & (F.col("human") == 1), F.lit("service_account_human_pivot")), F.when(F.col("accounts") > 1, F.lit("cross_boundary"))))
    return a.select("actor", "nodes", "accounts", F.array_join(flags, ",").alias("flags")).where("flags != ''")


def _p(f):
    return lambda s, d: f(cut(placed(events(s, d))))


QUERIES = {"a1_privilege_escalation": _p(privilege_escalation), "a5_privilege_chain": _p(privilege_chain), "a9_graph_movement": _p(graph_movement), "a11_escalation_events": _p(escalation_events)}

_TRAIL = f"OVER (PARTITION BY actor ORDER BY us RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW)"
_PRIOR = f"OVER (PARTITION BY actor ORDER BY us RANGE BETWEEN {3 * DAY} PRECEDING AND 1 PRECEDING)"
_WAYS = f""", rl AS (SELECT DISTINCT k FROM pl), tg AS (SELECT k AS src, k // 2 AS dst FROM rl WHERE k >= 1 UNION SELECT k, 2 * k + 1 FROM rl WHERE k % 33 = 0 AND 2 * k + 1 IN (SELECT k FROM rl)),
 rt AS (SELECT src AS root, dst AS node, 1 AS h FROM tg UNION SELECT root, dst, h + 1 FROM rt JOIN tg ON node = src WHERE h < {DEPTH}), rh AS (SELECT root, node, min(h) AS h FROM rt WHERE root <> node GROUP BY ALL),
 cl AS (SELECT src AS root, dst AS node FROM tg UNION SELECT root, dst FROM cl JOIN tg ON node = src), wy AS (SELECT k, min_by(node, h * 1000000 + node) AS nearest, min(h) AS hops, max(h) AS far FROM (SELECT k, k AS node, 0 AS h FROM rl UNION ALL SELECT * FROM rh) WHERE node % 10 = 0 GROUP BY k),
 asm AS (SELECT pl.*, 'acc' || ((pl.k + actor) % 7) AS role_account, nearest, hops, far, far + 2 AS nodes, pl.k IN (SELECT root FROM cl WHERE root = node) AS cyclic FROM pl LEFT JOIN wy ON wy.k = pl.k WHERE action = 'purchase')"""
_ROWS = lambda name, detector, found: f", {name} AS (" + " UNION ALL ".join(f"SELECT '{detector}' AS detector, '{t}' AS subtype, actor, CAST({x} AS VARCHAR) AS subject, event_id, {v if v.startswith('CASE') else repr(v)} AS severity FROM {f}" for t, v, x, f in found) + ")"
ESCALATION_SQL = _WAYS + _ROWS("escalation_rows", "escalation", [
    ("direct_high_priv_assumption", "critical", "role", "asm WHERE regexp_matches(role, 'Admin')"), ("graph_path_escalation", "CASE WHEN hops + 1 <= 2 THEN 'critical' ELSE 'high' END", "role", "asm WHERE hops IS NOT NULL"),
    ("cross_account_escalation", "critical", "role", "asm WHERE k % 10 = 0 AND account <> role_account"), ("wildcard_policy_abuse", "high", "role", "asm WHERE event_id % 13 = 0"),
])
CHAIN_SQL = f""", ac2 AS (SELECT *, max(nodes) {_PRIOR} AS old, count(*) {_PRIOR} AS seen FROM asm WHERE hops IS NOT NULL)""" + _ROWS("chain_rows", "chain", [
    ("deep_escalation_chain", "CASE WHEN nodes >= 7 THEN 'critical' ELSE 'high' END", "role", "ac2 WHERE nodes >= 5"), ("circular_role_chain", "high", "role", "ac2 WHERE cyclic"),
    ("converging_chains", "high", "nearest", "ac2 WHERE nearest IN (SELECT nearest FROM ac2 GROUP BY nearest HAVING count(DISTINCT actor) >= 4)"), ("chain_acceleration", "high", "role", "ac2 WHERE seen >= 2 AND nodes >= 2 * old"),
])
_HEAD = PLACED.replace("WITH ev", "WITH RECURSIVE ev")
ORACLE = {
    "a1_privilege_escalation": _HEAD + ESCALATION_SQL + " SELECT * FROM escalation_rows",
    "a5_privilege_chain": _HEAD + _WAYS + CHAIN_SQL + " SELECT * FROM chain_rows",
    "a9_graph_movement": _HEAD + _WAYS + """, mv AS (SELECT *, k % 10 - lag(k % 10) OVER (PARTITION BY actor ORDER BY us, event_id) AS rise FROM asm), ag AS (SELECT actor, max(nodes) AS nodes, max(CASE WHEN hops >= 1 THEN 1 ELSE 0 END) AS pv, max(rise) AS rise, count(DISTINCT account) AS accounts, max(CASE WHEN starts_with(role, 'svc-') THEN 0 ELSE 1 END) AS human FROM mv GROUP BY actor)
 SELECT * FROM (SELECT actor, nodes, accounts, concat_ws(',', CASE WHEN nodes >= 4 THEN 'hop_chain' END, CASE WHEN pv = 1 THEN 'high_value_pivot' END, CASE WHEN rise >= 5 THEN 'privilege_pivot' END, CASE WHEN actor % 7 = 0 AND human = 1 THEN 'service_account_human_pivot' END, CASE WHEN accounts > 1 THEN 'cross_boundary' END) AS flags FROM ag) WHERE flags <> ''""",
    "a11_escalation_events": _HEAD + _WAYS + f""", ax AS (SELECT *, count(*) {_TRAIL} AS n, sum(value) {_TRAIL} AS total FROM asm), ay AS (SELECT *, max(us) FILTER (action = 'error') OVER (PARTITION BY actor ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lost, count(*) FILTER (action = 'signup') {_TRAIL} AS signs FROM pl)""" + _ROWS("es", "graph_escalation", [
        ("direct_escalation", "critical", "role", "ax WHERE hops = 0"), ("path_escalation", "critical", "role", "ax WHERE hops BETWEEN 1 AND 2"), ("repeated_escalation", "high", "role", "ax WHERE n >= 3"),
        ("factor_lost_before", "critical", "role", f"ay WHERE action = 'purchase' AND us - lost <= {12 * HOUR}"), ("policy_spree", "high", "role", "ay WHERE action = 'signup' AND signs >= 3"), ("cumulative_escalation", "high", "role", "ax WHERE total >= 200"),
    ]) + " SELECT * FROM es",
}
