"""Edges through time: revocation and revival, what is active when, windows around a moment, privileges over trust, statistics, deletion, and graphs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brinewatch.operators import escalation, graphs
from brinewatch.operators.graphs import access_edges
from brinewatch.sources.tables import DAY, EV, HOUR, cut, events


def lives(ev: DataFrame) -> DataFrame:
    """(src, dst, life from 1, n, born_us, last_us, revoked_us): an actor's error on a resource revokes its edge to it, the next use revives it as a new life. Gaps and islands."""
    e = ev.select(F.col("actor").alias("src"), F.col("resource").alias("dst"), "us", "event_id", (F.col("action") == "error").alias("revokes"))
    w = W.partitionBy("src", "dst").orderBy("us", "event_id")
    e = e.withColumn("ended", F.coalesce(F.sum(F.when(F.col("revokes"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    uses = e.groupBy("src", "dst", "ended").agg(F.count(F.when(~F.col("revokes"), 1)).alias("n"), F.min(F.when(~F.col("revokes"), F.col("us"))).alias("born_us"), F.max(F.when(~F.col("revokes"), F.col("us"))).alias("last_us"), F.max(F.when(F.col("revokes"), F.col("us"))).alias("revoked_us"))
    uses = uses.where("n > 0")  # a second revocation in a row ends nothing
    return uses.select("src", "dst", F.row_number().over(W.partitionBy("src", "dst").orderBy("ended")).cast("bigint").alias("life"), "n", "born_us", "last_us", "revoked_us")


def active_at(edges: DataFrame, us: Column, ttl: int = 9 * DAY) -> DataFrame:
    """Lives that hold at a moment: born, not revoked by then, and used within their time to live before it or later."""
    return edges.where((F.col("born_us") <= us) & (F.col("revoked_us").isNull() | (F.col("revoked_us") > us)) & (F.col("last_us") + ttl >= us))


def edges_in_window(ev: DataFrame, start: int, end: int) -> DataFrame:
    """Uses between two moments, both counted."""
    return access_edges(ev).where(F.col("us").between(start, end))


def neighbours_around(ev: DataFrame, moments: DataFrame, us: int = 6 * HOUR) -> DataFrame:
    """For each (node, at) how many uses, and of how many others, lie within us of it on either side.

    Uses and moments meet in slots of us: a moment asks its own slot and those beside it, so no node's whole history meets all its moments.
    """
    slot = F.floor(F.col("us") / us)
    asks = moments.withColumn("slot", F.explode(F.sequence(F.floor(F.col("at") / us) - 1, F.floor(F.col("at") / us) + 1)))
    met = asks.join(access_edges(ev).select(F.col("src").alias("node"), "dst", "us", slot.alias("slot")), ["node", "slot"]).where(F.abs(F.col("us") - F.col("at")) <= us)
    return met.groupBy("node", "at").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("others"))


def session_edges(ev: DataFrame) -> DataFrame:
    """Edges by session (an actor's half day): uses and resources."""
    s = F.concat_ws(":", F.col("actor").cast("string"), F.floor(F.col("us") / (12 * HOUR)).cast("string"))
    return ev.groupBy(s.alias("session")).agg(F.count("*").alias("n"), F.countDistinct("resource").alias("resources")).where("n >= 3")


def privilege_closure(ev: DataFrame, rounds: int = 10) -> DataFrame:
    """Each role's privilege: the largest level (number mod 10) of it and of what it leads to over trust, spread from end to start until none rises, in at most ten rounds."""
    edges = cut(escalation.trust(ev))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(ev.select("k")).where("node is not null").distinct()
    level = cut(nodes.select("node", (F.col("node") % 10).alias("level")))
    for _ in range(rounds):
        led = edges.join(level.select(F.col("node").alias("dst"), F.col("level").alias("theirs")), "dst").groupBy(F.col("src").alias("node")).agg(F.max("theirs").alias("theirs"))
        new = cut(level.join(led, "node", "left").select("node", F.greatest("level", "theirs").alias("level"), (F.col("theirs") > F.col("level")).alias("rose")))
        level, rose = new.select("node", "level"), not new.where("rose").isEmpty()
        if not rose:
            break
    return level


def reachable_privileged(ev: DataFrame, least: int = 7) -> DataFrame:
    """How many roles of a level of at least seven each actor can come to: those it assumed, and all that they lead to over trust."""
    edges = cut(escalation.trust(ev))
    held = ev.where("action = 'purchase'").select("actor", "k").distinct()
    led = graphs.reach(edges, 8).select(F.col("root").alias("k"), "node")
    all_roles = held.select("actor", F.col("k").alias("node")).union(held.join(led, "k").select("actor", "node")).distinct()
    return all_roles.where(F.col("node") % 10 >= least).groupBy("actor").agg(F.count("*").alias("n"), F.max("node").alias("largest"))


def graph_stats(ev: DataFrame) -> DataFrame:
    """Nodes and edges by kind."""
    e = access_edges(ev).select("src", "dst", "kind").distinct()
    kind = F.when(F.col("node").startswith("u"), "identity").when(F.col("node").startswith("role"), "role").otherwise("resource")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().groupBy(F.concat(F.lit("node:"), kind).alias("what")).agg(F.count("*").alias("n"))
    return nodes.unionAll(e.groupBy(F.concat(F.lit("edge:"), F.col("kind")).alias("what")).agg(F.count("*").alias("n")))


def hubs_and_targets(ev: DataFrame, k: int = 5) -> DataFrame:
    """The k nodes of most ways out, and of most ways in."""
    d = cut(graphs.degrees(access_edges(ev).select("src", "dst").distinct()))
    top = lambda c, what: d.orderBy(F.desc(c), "node").limit(k).select(F.lit(what).alias("what"), "node", F.col(c).alias("degree"))
    return top("out_degree", "hub").unionAll(top("in_degree", "target"))


def deleted(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of gone, and without edges at either end of which they are."""
    drop = gone.select("node").distinct()
    left = edges.join(drop.withColumnRenamed("node", "src"), "src", "left_anti").join(drop.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return nodes.join(drop, "node", "left_anti"), left


def imported(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, type) and edges (src, dst, weight) as a store holds them: type generic and weight 1.0 where there is none, ends of edges added as nodes, one row a key."""
    n = nodes.select("node", F.coalesce("type", F.lit("generic")).alias("type"))
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().join(n, "node", "left_anti").select("node", F.lit("generic").alias("type"))
    kept = n.groupBy("node").agg(F.min("type").alias("type")).unionAll(ends)
    return kept, edges.groupBy("src", "dst").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))


def exported(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The subgraph of nodes as rows of JSON: a node each and the edges between them, with times in ISO form."""
    inner = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    iso = F.date_format(F.timestamp_micros("last_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = inner.select(F.lit("edge").alias("kind"), F.to_json(F.struct("src", "dst", iso.alias("last_seen"))).alias("json"))
    return nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("node")).alias("json")).unionAll(rows)


def compared_radius(edges: DataFrame, nodes: list[int], depth: int = 3) -> DataFrame:
    """Blast radius of some nodes side by side, the worst first."""
    roots = edges.sparkSession.createDataFrame([(n,) for n in nodes], "root int")
    r = graphs.reach(edges, depth, roots).withColumn("risk", (F.col("node") % 7) / 10.0)
    score = F.least(F.lit(1.0), 0.6 * F.avg("risk") + 0.4 * F.max("risk"))
    a = r.groupBy("root").agg(F.count("*").alias("n"), F.round(score, 6).alias("score"))
    return a.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "root")).cast("bigint"))  # a row a node that was asked for


def _e(f, *a):
    return lambda s, d: f(events(s, d), *a)


NOON = 1_705_320_000_000_000  # the 15th of the test data's month, noon


def _around(s, d):
    ev = events(s, d)
    return neighbours_around(ev, ev.where("event_id % 50 = 0").select(F.concat(F.lit("u"), F.col("actor").cast("string")).alias("node"), F.col("us").alias("at")).distinct())


def _deleted(s, d):
    e = access_edges(events(s, d)).select("src", "dst").distinct()
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    n, left = deleted(nodes, e, nodes.where("node in ('res-7', 'role1', 'u3')"))
    return n.agg(F.count("*").alias("nodes")).crossJoin(left.agg(F.count("*").alias("edges")))


def _imported(s, d):
    e = access_edges(events(s, d)).select("src", "dst", F.when(F.col("us") % 2 == 0, (F.col("us") % 7).cast("double")).alias("weight"))
    n, kept = imported(e.where("src like 'u%'").select(F.col("src").alias("node"), F.when(F.col("src").endswith("1"), "identity").alias("type")).distinct(), e)
    return n.groupBy("type").agg(F.count("*").alias("n")).unionAll(kept.groupBy(F.col("weight").cast("string").alias("type")).agg(F.count("*").alias("n")))


def _exported(s, d):
    e = access_edges(events(s, d)).groupBy("src", "dst").agg(F.max("us").alias("last_us"))
    return exported(e, e.where("src in ('u1', 'u2', 'role1')").select(F.col("src").alias("node")).union(e.where("src = 'u1'").select("dst")).distinct())


QUERIES = {
    "g2_lives": _e(lives), "f6_active_at": lambda s, d: active_at(lives(events(s, d)), F.lit(NOON)).select("src", "dst", "life"), "f7_edges_in_window": lambda s, d: edges_in_window(events(s, d), NOON - DAY, NOON + DAY).select("src", "dst", "kind", "us"),
    "f7_neighbours_around": _around, "f7_sessions": _e(session_edges), "g4_closure": _e(privilege_closure), "g5_reachable": _e(reachable_privileged), "g7_stats": _e(graph_stats), "g10_hubs": _e(hubs_and_targets), "g12_deleted": _deleted,
    "s10_imported": _imported, "s11_exported": _exported,
} | graphs.on_trade({"t14_compared": (compared_radius, [0, 3, 7, 12])})
_A = graphs._ACCESS
_LIVES = EV + """, e AS (SELECT actor AS src, resource AS dst, us, event_id, action = 'error' AS rv FROM ev), f AS (SELECT *, coalesce(sum(rv::INT) OVER (PARTITION BY src, dst ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e),
 g AS (SELECT src, dst, ended, count(*) FILTER (NOT rv) AS n, min(us) FILTER (NOT rv) AS born_us, max(us) FILTER (NOT rv) AS last_us, max(us) FILTER (rv) AS revoked_us FROM f GROUP BY ALL HAVING count(*) FILTER (NOT rv) > 0), lv AS (SELECT src, dst, row_number() OVER (PARTITION BY src, dst ORDER BY ended) AS life, n, born_us, last_us, revoked_us FROM g)"""
_TRUST = EV.replace("WITH ev", "WITH RECURSIVE ev") + """, rl AS (SELECT DISTINCT k FROM ev), tg AS (SELECT k AS src, k // 2 AS dst FROM rl WHERE k >= 1 UNION SELECT k, 2 * k + 1 FROM rl WHERE k % 33 = 0 AND 2 * k + 1 IN (SELECT k FROM rl)),
 cl AS (SELECT src AS root, dst AS node FROM tg UNION SELECT root, dst FROM cl JOIN tg ON node = src)"""
ORACLE = {
    "g2_lives": _LIVES + " SELECT * FROM lv",
    "f6_active_at": _LIVES + f" SELECT src, dst, life FROM lv WHERE born_us <= {NOON} AND (revoked_us IS NULL OR revoked_us > {NOON}) AND last_us + {9 * DAY} >= {NOON}",
    "f7_edges_in_window": _A + f" SELECT src, dst, kind, us FROM ac WHERE us BETWEEN {NOON - DAY} AND {NOON + DAY}",
    "f7_neighbours_around": _A + f", m AS (SELECT DISTINCT 'u' || actor AS node, us AS tm FROM ev WHERE event_id % 50 = 0) SELECT node, tm AS at, count(*) AS n, count(DISTINCT dst) AS others FROM m JOIN ac ON src = node AND abs(us - tm) <= {6 * HOUR} GROUP BY ALL",
    "f7_sessions": EV + f" SELECT actor || ':' || (us // {12 * HOUR}) AS session, count(*) AS n, count(DISTINCT resource) AS resources FROM ev GROUP BY 1 HAVING count(*) >= 3",
    "g4_closure": _TRUST + ", nd AS (SELECT k AS node FROM rl UNION SELECT src FROM tg UNION SELECT dst FROM tg) SELECT nd.node, greatest(nd.node % 10, coalesce(max(cl.node % 10), 0)) AS level FROM nd LEFT JOIN cl ON root = nd.node GROUP BY nd.node",
    "g5_reachable": _TRUST + ", h AS (SELECT DISTINCT actor, k FROM ev WHERE action = 'purchase'), a AS (SELECT actor, k AS node FROM h UNION SELECT actor, node FROM h JOIN cl ON root = k) SELECT actor, count(*) AS n, max(node) AS largest FROM a WHERE node % 10 >= 7 GROUP BY actor",
    "g7_stats": _A + ", e AS (SELECT DISTINCT src, dst, kind FROM ac), nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT 'node:' || CASE WHEN starts_with(node, 'u') THEN 'identity' WHEN starts_with(node, 'role') THEN 'role' ELSE 'resource' END AS what, count(*) AS n FROM nd GROUP BY 1 UNION ALL SELECT 'edge:' || kind, count(*) FROM e GROUP BY 1",
    "g10_hubs": _A + ", e AS (SELECT DISTINCT src, dst FROM ac), nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e), d AS (SELECT node, (SELECT count(*) FROM e WHERE src = node) AS o, (SELECT count(*) FROM e WHERE dst = node) AS i FROM nd) (SELECT 'hub' AS what, node, o AS degree FROM d ORDER BY o DESC, node LIMIT 5) UNION ALL (SELECT 'target', node, i FROM d ORDER BY i DESC, node LIMIT 5)",
    "g12_deleted": _A + ", e AS (SELECT DISTINCT src, dst FROM ac), nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT (SELECT count(*) FROM nd WHERE node NOT IN ('res-7', 'role1', 'u3')) AS nodes, (SELECT count(*) FROM e WHERE src NOT IN ('res-7', 'role1', 'u3') AND dst NOT IN ('res-7', 'role1', 'u3')) AS edges",
    "s10_imported": _A + """, e AS (SELECT src, dst, CASE WHEN us % 2 = 0 THEN (us % 7)::DOUBLE END AS weight FROM ac), n AS (SELECT DISTINCT src AS node, CASE WHEN ends_with(src, '1') THEN 'identity' ELSE 'generic' END AS type FROM e WHERE src LIKE 'u%'), x AS (SELECT node, type FROM n UNION ALL SELECT node, 'generic' FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) WHERE node NOT IN (SELECT node FROM n)),
 w AS (SELECT src, dst, max(coalesce(weight, 1.0)) AS weight FROM e GROUP BY ALL) SELECT type, count(*) AS n FROM x GROUP BY type UNION ALL SELECT CAST(weight AS VARCHAR), count(*) FROM w GROUP BY 1""",
    "s11_exported": _A + """, e AS (SELECT src, dst, max(us) AS l FROM ac GROUP BY ALL), n AS (SELECT src AS node FROM e WHERE src IN ('u1', 'u2', 'role1') UNION SELECT dst FROM e WHERE src = 'u1') SELECT 'node' AS kind, '{"node":"' || node || '"}' AS json FROM n
 UNION ALL SELECT 'edge', '{"src":"' || src || '","dst":"' || dst || '","last_seen":"' || strftime(make_timestamp(l), '%Y-%m-%dT%H:%M:%SZ') || '"}' FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)""",
    "t14_compared": graphs._TRADE + graphs._reach(3, where="src IN (0, 3, 7, 12)") + ", a AS (SELECT root, count(*) AS n, round(least(1.0, 0.6 * avg((node % 7) / 10.0) + 0.4 * max((node % 7) / 10.0)), 6)::DOUBLE AS score FROM rc GROUP BY root) SELECT *, row_number() OVER (ORDER BY score DESC, root) AS place FROM a",
}
