"""Exposure and centrality on top of the graph operators: who reaches whom, by which way, and what that is worth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from brinewatch.operators import graphs as g
from brinewatch.sources.tables import cut, events


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def ancestors(edges: DataFrame, depth: int = 2) -> DataFrame:
    """Who reaches each node within depth."""
    return g.reach(reverse(edges), depth).select(F.col("root").alias("node"), F.col("node").alias("ancestor"), "hops")


def first_paths(edges: DataFrame, depth: int = 3) -> DataFrame:
    """One shortest path from each node to each it reaches: the least in text of those of fewest hops.

    Level by level one path a pair is kept. Of two paths of one pair with the same number of hops the lesser stays the lesser when both are
    continued by ">" and the same node, except where one is the beginning of the other, which two paths to one node can't be.
    """
    step = edges.where("src != dst").select("src", "dst").distinct()
    seen = front = step.select("src", "dst", F.lit(1).cast("bigint").alias("hops"), F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string")).alias("path"))
    hop = step.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    for k in range(2, depth + 1):
        new = front.join(hop, F.col("dst") == F.col("at")).where("next != src").groupBy("src", F.col("next").alias("dst")).agg(F.min(F.concat_ws(">", "path", F.col("next").cast("string"))).alias("path"))
        front = cut(new.join(seen, ["src", "dst"], "left_anti").select("src", "dst", F.lit(k).cast("bigint").alias("hops"), "path"))
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen


def highest_risk(edges: DataFrame, depth: int = 3) -> DataFrame:
    """The path of most risk from each node."""
    return g.riskiest(edges, depth, 1).drop("place")


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge a pair with the largest weight and the number merged."""
    doubled = edges.unionAll(edges.where("src % 2 = 0").withColumn("weight", F.col("weight") * 2))
    return doubled.groupBy("src", "dst").agg(F.max("weight").alias("weight"), F.count("*").alias("n"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Neighbours in either direction, without the node itself."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src")).where("node != other").distinct().groupBy("node").agg(F.count("*").alias("n"), F.min("other").alias("least"))


def subgraph(edges: DataFrame) -> DataFrame:
    """Edges with both ends among what node 0 reaches in two hops, and itself."""
    root = edges.sparkSession.createDataFrame([(0,)], "root int")
    keep = g.reach(edges, 2, root).select("node").unionAll(root.select(F.col("root").alias("node"))).distinct()
    return edges.join(keep, edges.src == keep.node, "left_semi").join(keep, F.col("dst") == keep.node, "left_semi")


def betweenness(edges: DataFrame, roots: int | None = None) -> DataFrame:
    """Share of shortest paths between others that pass each node: counts of shortest paths forward by level, dependencies back.

    Exact from all nodes. With a number of roots only paths from so many (those of the least hashes) are followed, and sums are scaled up by the share of nodes left
    out: work is in proportion to roots. Of n nodes an estimate is off by more than e * n * (n - 2) with a probability of at most 2 * exp(-2 * roots * e * e) (Hoeffding: a root's part of a node is between 0 and n - 2).
    """
    step = cut(edges.select("src", "dst").distinct())
    nodes = step.select(F.col("src").alias("node")).union(step.select("dst")).distinct()
    chosen = nodes if roots is None else cut(nodes.orderBy(F.xxhash64("node"), "node").limit(roots))
    scale = 1.0 if roots is None else nodes.count() / max(chosen.count(), 1)
    level = chosen.select(F.col("node").alias("root"), "node", F.lit(1.0).alias("sigma"))
    seen, k = level.withColumn("d", F.lit(0)), 0
    while True:  # a level is empty at last: no pair is seen twice
        new = level.join(step, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma")).join(seen.select("root", "node"), ["root", "node"], "left_anti")
        new = cut(new)
        if new.isEmpty():
            break
        k += 1
        level = new
        seen = seen.unionAll(new.withColumn("d", F.lit(k)))
    seen = cut(seen)
    part = seen.where(f"d = {k}").select("root", "node", "sigma", F.lit(0.0).alias("delta"))
    total = part.select("root", "node", "delta")
    for d in range(k - 1, 0, -1):
        below = part.select("root", F.col("node").alias("dst"), F.col("sigma").alias("s2"), "delta")
        got = seen.where(f"d = {d}").join(step, F.col("node") == F.col("src")).join(below, ["root", "dst"]).groupBy("root", "node").agg(F.sum(F.col("sigma") / F.col("s2") * (1 + F.col("delta"))).alias("x"))
        part = cut(seen.where(f"d = {d}").join(got, ["root", "node"], "left").select("root", "node", "sigma", F.coalesce("x", F.lit(0.0)).alias("delta")))
        total = total.unionAll(part.select("root", "node", "delta"))
    return nodes.join(total.where("root != node").groupBy("node").agg(F.sum("delta").alias("x")), "node", "left").select("node", F.round(scale * F.coalesce("x", F.lit(0.0)), 5).alias("betweenness"))


def attack_surface(edges: DataFrame) -> DataFrame:
    """Entry points (nodes mod 4 = 0): what they reach in three hops, sensitive ones (mod 5 = 0) among it, severity."""
    roots = edges.where("src % 4 = 0").select(F.col("src").alias("root")).distinct()
    r = g.reach(edges, 3, roots)
    a = r.groupBy("root").agg(F.count("*").alias("n"), F.count(F.when(F.col("node") % 5 == 0, 1)).alias("sensitive"), F.min(F.when(F.col("node") % 5 == 0, F.col("hops"))).alias("nearest"))
    return a.withColumn("severity", F.when((F.col("nearest") <= 1) | (F.col("n") > 50), "high").when(F.col("sensitive") > 0, "medium").otherwise("low"))


def longest_chains(edges: DataFrame, depth: int = 3) -> DataFrame:
    """The longest simple path of each node, up to depth: the least in text."""
    best = g.paths(edges, depth).groupBy("src").agg(F.min(F.struct((-F.col("hops")).alias("h"), "path")).alias("b"))
    return best.select("src", (-F.col("b.h")).alias("hops"), F.col("b.path").alias("path"))


def gini(edges: DataFrame) -> DataFrame:
    """Inequality of in degrees, by ranks, and the mean number of paths between pairs that reach each other. Nodes of one degree hold a run of ranks, so only different degrees are put in order."""
    d = g.degrees(edges).groupBy("in_degree").agg(F.count("*").alias("m"))
    d = d.withColumn("before", F.coalesce(F.sum("m").over(W.orderBy("in_degree").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranks, n = F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2, F.sum("m")
    a = d.agg(F.round(2 * F.sum(ranks * F.col("in_degree")) / (n * F.sum(F.col("m") * F.col("in_degree"))) - (n + 1) / n, 6).alias("gini"))
    m = g.paths(edges, 3).groupBy("src", "dst").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("multiplicity"))
    return a.crossJoin(F.broadcast(m))


def converging(ev: DataFrame, least: int = 3) -> DataFrame:
    """Resources that many actors reach through roles."""
    e = g.access_edges(ev).select("src", "dst").distinct()
    two = e.where("src like 'u%'").select(F.col("src").alias("actor"), F.col("dst").alias("mid")).join(e.where("src like 'role%'"), F.col("mid") == F.col("src"))
    return two.groupBy("dst").agg(F.countDistinct("actor").alias("actors"), F.countDistinct("mid").alias("roles")).where(F.col("actors") >= least)


def relays(edges: DataFrame) -> DataFrame:
    """Nodes with at least two ways in and two ways out."""
    return g.degrees(edges).where("in_degree >= 2 and out_degree >= 2").select("node", "in_degree", "out_degree")


def node_risk(edges: DataFrame, depth: int = 3) -> DataFrame:
    """Each node's risk: .25 of its reach, .20 of what is reached by kind (number mod 5), .20 of its paths of risk .5 or more, .15 of the critical nodes reached (every seventh), .10 of its degree, and .25 if it is in a cycle; and the tier."""
    n = g.degrees(edges).select("node", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    r = g.reach(edges, depth).groupBy("root").agg(F.count("*").alias("reached"), F.sum(F.col("node") % 5).alias("weighted"), F.count(F.when(F.col("node") % 7 == 0, 1)).alias("critical"))
    p = g.paths(edges, depth).where("risk >= 0.5").groupBy("src").agg(F.count("*").alias("paths"))
    c = g.cycles(edges).select("node", F.lit(1).alias("cyclic"))
    size = n.agg(F.count("*").alias("size"))
    x = n.join(r, n.node == r.root, "left").join(p, n.node == p.src, "left").join(c, "node", "left").fillna(0).crossJoin(F.broadcast(size))  # one row
    share = lambda c, most: F.least(F.col(c) / most, F.lit(1.0))
    score = 0.25 * share("reached", F.greatest(F.col("size") * 0.1, F.lit(10.0))) + 0.20 * share("weighted", F.lit(50.0)) + 0.20 * share("paths", F.lit(30.0)) + 0.15 * share("critical", F.lit(10.0)) + 0.10 * share("degree", F.greatest(F.col("size") * 0.05, F.lit(5.0))) + 0.25 * F.col("cyclic")
    x = x.withColumn("score", F.least(F.round(score, 4), F.lit(1.0)))
    return x.select("node", "reached", "paths", "score", F.when(F.col("score") >= 0.8, "CRITICAL").when(F.col("score") >= 0.6, "HIGH").when(F.col("score") >= 0.35, "MEDIUM").otherwise("LOW").alias("tier"))


def markov(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """A walk that stays with .1, follows edges with .8 of their weight and goes anywhere with .01: rows are normalised, the background is one sum a round."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    n = nodes.count()
    mass = nodes.join(edges.groupBy("src").agg(F.sum(0.8 * F.col("weight")).alias("w"), F.count("*").alias("k")), nodes.node == F.col("src"), "left").select("node", (F.lit(0.1) + F.coalesce("w", F.lit(0.0)) + 0.01 * (n - 1 - F.coalesce("k", F.lit(0)))).alias("z"))
    mass, edges = cut(mass), cut(edges.select("src", "dst", "weight"))
    p = mass.select("node", F.lit(1.0 / n).alias("p"))
    for _ in range(rounds):  # a round reads p three times, so each is cut: without that the plan triples a round
        q = p.join(mass, "node").select("node", (F.col("p") / F.col("z")).alias("q"))
        everywhere = q.agg(F.sum("q").alias("t"))
        own = q.select("node", (F.col("q") * 0.09).alias("x"))
        along = q.join(edges, q.node == edges.src).select(F.col("dst").alias("node"), (F.col("q") * (0.8 * F.col("weight") - 0.01)).alias("x"))
        p = cut(own.unionAll(along).groupBy("node").agg(F.sum("x").alias("x")).crossJoin(F.broadcast(everywhere)).select("node", (F.col("x") + 0.01 * F.col("t")).alias("p")))
    return p.select("node", F.round("p", 6).alias("p"))


def jewel_access(ev: DataFrame) -> DataFrame:
    """Exposure of the resources whose number ends in 0: actors, uses, errors."""
    a = ev.where("k % 10 = 0").groupBy("resource").agg(F.countDistinct("actor").alias("actors"), F.count("*").alias("n"), F.avg(F.when(F.col("action") == "error", 1.0).otherwise(0.0)).alias("bad"))
    score = 0.3 * F.least(F.col("actors") / 20.0, F.lit(1.0)) + 0.2 * F.least(F.col("n") / 100.0, F.lit(1.0)) + 0.3 * F.col("bad") + 0.1
    return a.select("resource", "actors", "n", F.round(score, 6).alias("exposure"))


def multiplied_paths(edges: DataFrame, depth: int = 3, least: float = 1.5) -> DataFrame:
    """Simple paths whose risk, the sum of weights times their relation's multiplier (1, 1.5 or 2 by (src + dst) mod 3), is at least so much."""
    e = edges.select("src", "dst", F.round(F.col("weight") * (1 + ((F.col("src") + F.col("dst")) % 3) * 0.5), 3).alias("weight"))
    return g.paths(e, depth).where(F.col("risk") >= least)


def jewel_alerts(ev: DataFrame) -> DataFrame:
    """Uses of the resources whose number ends in 0: critical for errors, high for purchases, medium where the actor is new to the resource, else low."""
    first = F.row_number().over(W.partitionBy("resource", "actor").orderBy("us", "event_id")) == 1
    severity = F.when(F.col("action") == "error", "critical").when(F.col("action") == "purchase", "high").when(first, "medium").otherwise("low")
    return ev.where("k % 10 = 0").select("event_id", "resource", "actor", severity.alias("severity"))


def jewels_ranked(ev: DataFrame, least: int = 5) -> DataFrame:
    """Jewels found by use (a share of purchases and errors over two fifths and so many actors) with their exposure, the most exposed first."""
    a = ev.groupBy("resource").agg(F.countDistinct("actor").alias("actors"), F.round(F.avg(F.when(F.col("action").isin("purchase", "error"), 1.0).otherwise(0.0)), 6).alias("hot"))
    found = a.where((F.col("actors") >= least) & (F.col("hot") > 0.4))
    return found.select("resource", "actors", "hot", F.row_number().over(W.orderBy(F.desc("hot"), "resource")).cast("bigint").alias("place"))  # a row a jewel


def _e(f, *a):
    return lambda s, d: f(events(s, d), *a)


QUERIES = {"a5_converging": _e(converging), "a12_jewel_access": _e(jewel_access), "a12_alerts": _e(jewel_alerts), "a12_ranked": _e(jewels_ranked), "t16_sampled": lambda s, d: betweenness(cut(g.access_edges(events(s, d)).select("src", "dst").distinct()), 40)} | g.on_trade({
    "t2_ancestors": (ancestors,), "t3_first_paths": (first_paths,), "t6_multiplied": (multiplied_paths,), "t7_highest_risk": (highest_risk,), "g8_merged_edges": (merged_edges,), "g11_neighbours": (neighbours,), "g13_subgraph": (subgraph,), "t16_betweenness": (betweenness,),
    "t19_attack_surface": (attack_surface,), "t20_longest_chains": (longest_chains,), "t21_gini": (gini,), "a9_relays": (relays,), "r6_node_risk": (node_risk,), "r12_markov": (markov,),
})

_T = g._TRADE
_BEST = _T + g._paths(3) + ", bp AS (SELECT src, dst, path, hops, risk FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY risk DESC, path) AS r FROM pa) WHERE r = 1)"
_N = ", nd AS (SELECT src AS node FROM tr UNION SELECT dst FROM tr)"


def _markov(n: int) -> str:
    sql = _T + _N + """, cn AS (SELECT count(*) AS c FROM nd), mx AS MATERIALIZED (SELECT a.node AS i, b.node AS j, CASE WHEN a.node = b.node THEN 0.1 WHEN weight IS NOT NULL THEN 0.8 * weight ELSE 0.01 END AS v FROM nd a CROSS JOIN nd b LEFT JOIN tr ON src = a.node AND dst = b.node),
 mn AS MATERIALIZED (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM mx), w0 AS (SELECT node, 1.0::DOUBLE / c AS p FROM nd, cn)"""
    for k in range(n):
        sql += f", w{k + 1} AS MATERIALIZED (SELECT j AS node, sum(p * v) AS p FROM w{k} JOIN mn ON i = node GROUP BY j)"
    return sql + f" SELECT node, round(p, 6) AS p FROM w{n}"


ORACLE = {
    "t6_multiplied": _T + ", tw AS (SELECT src, dst, round(weight * (1 + ((src + dst) % 3) * 0.5), 3)::DOUBLE AS weight FROM tr)" + g._paths(3).replace("FROM tr WHERE", "FROM tw WHERE").replace("JOIN tr ON ps.dst = tr.src", "JOIN tw tr ON ps.dst = tr.src") + " SELECT src, dst, path, hops, round(risk, 6)::DOUBLE AS risk FROM pa WHERE risk >= 1.5",
    "a12_alerts": g.EV + " SELECT event_id, resource, actor, CASE WHEN action = 'error' THEN 'critical' WHEN action = 'purchase' THEN 'high' WHEN row_number() OVER (PARTITION BY resource, actor ORDER BY us, event_id) = 1 THEN 'medium' ELSE 'low' END AS severity FROM ev WHERE k % 10 = 0",
    "a12_ranked": g.EV + ", a AS (SELECT resource, count(DISTINCT actor) AS actors, round(avg((action IN ('purchase', 'error'))::INT), 6) AS hot FROM ev GROUP BY resource) SELECT *, row_number() OVER (ORDER BY hot DESC, resource) AS place FROM a WHERE actors >= 5 AND hot > 0.4",
    "t2_ancestors": _T + ", bk AS (SELECT dst AS src, src AS dst FROM tr)" + g._reach(2, "bk") + " SELECT root AS node, node AS ancestor, hops FROM rc",
    "t3_first_paths": _T + g._paths(3) + " SELECT src, dst, hops, path FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY hops, path) AS r FROM pa) WHERE r = 1",
    "t7_highest_risk": _BEST + " SELECT src, dst, path, hops, risk FROM bp",
    "g8_merged_edges": _T + " SELECT src, dst, max(w) AS weight, count(*) AS n FROM (SELECT src, dst, weight AS w FROM tr UNION ALL SELECT src, dst, weight * 2 FROM tr WHERE src % 2 = 0) GROUP BY ALL",
    "g11_neighbours": _T + " SELECT node, count(*) AS n, min(other) AS least FROM (SELECT src AS node, dst AS other FROM tr UNION SELECT dst, src FROM tr) WHERE node <> other GROUP BY node",
    "g13_subgraph": _T + g._reach(2, where="src = 0") + ", kp AS (SELECT node FROM rc UNION SELECT 0) SELECT * FROM tr WHERE src IN (SELECT node FROM kp) AND dst IN (SELECT node FROM kp)",
    "t19_attack_surface": _T + g._reach(3, where="src % 4 = 0") + """, sf AS (SELECT root, count(*) AS n, count(*) FILTER (node % 5 = 0) AS sensitive, min(hops) FILTER (node % 5 = 0) AS nearest FROM rc GROUP BY root)
 SELECT *, CASE WHEN nearest <= 1 OR n > 50 THEN 'high' WHEN sensitive > 0 THEN 'medium' ELSE 'low' END AS severity FROM sf""",
    "t20_longest_chains": _T + g._paths(3) + " SELECT src, hops, min(path) AS path FROM pa JOIN (SELECT src, max(hops) AS hops FROM pa GROUP BY src) USING (src, hops) GROUP BY ALL",
    "t21_gini": _T + g._DEG + g._paths(3) + """, rn AS (SELECT *, row_number() OVER (ORDER BY in_degree, node) AS r FROM dg) SELECT round(2 * sum(r * in_degree) / (count(*) * sum(in_degree)) - (count(*) + 1.0) / count(*), 6)::DOUBLE AS gini, (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM pa GROUP BY src, dst)) AS multiplicity FROM rn""",
    "a5_converging": g._ACCESS + ", e AS (SELECT DISTINCT src, dst FROM ac) SELECT b.dst, count(DISTINCT a.src) AS actors, count(DISTINCT b.src) AS roles FROM e a JOIN e b ON a.dst = b.src WHERE a.src LIKE 'u%' AND b.src LIKE 'role%' GROUP BY b.dst HAVING count(DISTINCT a.src) >= 3",
    "a9_relays": _T + g._DEG + " SELECT node, in_degree, out_degree FROM dg WHERE in_degree >= 2 AND out_degree >= 2",
    "r6_node_risk": _T + g._DEG + g._reach(3) + g._paths(3) + """, rd AS (SELECT root, count(*) AS reached, sum(node % 5) AS weighted, count(*) FILTER (node % 7 = 0) AS critical FROM rc GROUP BY root), pn AS (SELECT src, count(*) AS paths FROM pa WHERE risk >= 0.5 GROUP BY src), r2 AS (SELECT src AS root, dst AS node FROM tr UNION SELECT r2.root, e.dst FROM r2 JOIN tr e ON r2.node = e.src), cy AS (SELECT DISTINCT a.root AS node FROM r2 a JOIN r2 b ON a.root = b.node AND a.node = b.root WHERE a.root <> a.node),
 sz AS (SELECT count(*) AS z FROM dg), sc AS (SELECT dg.node, coalesce(reached, 0) AS reached, coalesce(paths, 0) AS paths, least(1.0, round(0.25 * least(coalesce(reached, 0) / greatest(z * 0.1, 10), 1) + 0.2 * least(coalesce(weighted, 0) / 50, 1) + 0.2 * least(coalesce(paths, 0) / 30, 1) + 0.15 * least(coalesce(critical, 0) / 10, 1) + 0.1 * least((out_degree + in_degree) / greatest(z * 0.05, 5), 1) + 0.25 * (dg.node IN (SELECT node FROM cy))::INT, 4))::DOUBLE AS score FROM sz, dg LEFT JOIN rd ON root = dg.node LEFT JOIN pn ON pn.src = dg.node)
 SELECT *, CASE WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH' WHEN score >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM sc""",
    "r12_markov": _markov(10),
    "t16_betweenness": _T + _N + """, st AS (SELECT DISTINCT src, dst FROM tr), rr AS (SELECT node AS s, node AS t, 0 AS h FROM nd UNION SELECT s, dst, h + 1 FROM rr JOIN st ON t = src WHERE h < 24), ds AS (SELECT s, t, min(h) AS d FROM rr GROUP BY ALL),
 sg AS (SELECT s, t, 0 AS d, 1.0::DOUBLE AS c FROM ds WHERE s = t UNION ALL SELECT sg.s, st.dst, sg.d + 1, sum(c) FROM sg JOIN st ON sg.t = st.src JOIN ds ON ds.s = sg.s AND ds.t = st.dst AND ds.d = sg.d + 1 GROUP BY ALL),
 bt AS (SELECT a.t AS node, sum(a.c * b.c / e.c) AS x FROM sg a JOIN sg b ON b.s = a.t JOIN sg e ON e.s = a.s AND e.t = b.t AND e.d = a.d + b.d WHERE a.s <> a.t AND b.s <> b.t AND a.s <> b.t GROUP BY a.t) SELECT nd.node, round(coalesce(x, 0), 5)::DOUBLE AS betweenness FROM nd LEFT JOIN bt USING (node)""",
    "a12_jewel_access": g.EV + " SELECT resource, count(DISTINCT actor) AS actors, count(*) AS n, round(0.3 * least(count(DISTINCT actor) / 20.0, 1) + 0.2 * least(count(*) / 100.0, 1) + 0.3 * avg((action = 'error')::INT) + 0.1, 6)::DOUBLE AS exposure FROM ev WHERE k % 10 = 0 GROUP BY resource",
}
