"""Graphs of nations and of users and resources: building, degrees, reach, paths, components, propagation.

Traversals expand a frontier of (root, node) pairs by one join a level and keep what is new, so cost follows the pairs reached, not
the paths. Path listings carry the path as an array and are bounded by depth. Ties are broken by the smaller node or path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from brinewatch.sources.tables import DAY, EV, cut, events, read


def trade(spark: SparkSession, sf_dir: str, k: int | None = 3) -> DataFrame:
    """src, dst, weight: for each customer nation the k supplier nations (None: all) with most trade for their number of suppliers."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    supp = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    n = supp.groupBy("dst").agg(F.count("*").alias("n"))
    t = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    t = t.groupBy("src", "dst").agg(F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).alias("s")).join(n, "dst").where("src != dst")
    t = t.withColumn("w", F.round(F.col("s").cast("double") / F.col("n"), 2))
    place = F.row_number().over(W.partitionBy("src").orderBy(F.desc("w"), "dst"))
    t = t.withColumn("place", place)
    return (t if k is None else t.where(F.col("place") <= k)).select("src", "dst", F.round(1.0 / F.col("place"), 6).alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """In and out degree, and centrality, of every node."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    n = d.agg((F.count("*") - 1).alias("m"))
    return d.crossJoin(F.broadcast(n)).select("node", "out_degree", "in_degree", F.round((F.col("out_degree") + F.col("in_degree")) / (2 * F.greatest("m", F.lit(1))), 6).alias("centrality"))


def density(edges: DataFrame) -> DataFrame:
    """Nodes, edges, density, and how many nodes have no way in or no way out."""
    d = degrees(edges)
    a = d.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.count(F.when(F.col("in_degree") == 0, 1)).alias("no_in"), F.count(F.when(F.col("out_degree") == 0, 1)).alias("no_out"))
    return a.withColumn("density", F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6))


def reach(edges: DataFrame, depth: int, roots: DataFrame | None = None) -> DataFrame:
    """(root, node, hops) of all nodes within depth of each root (default: every node), the root itself left out."""
    step = edges.select("src", "dst").distinct()
    first = step.select(F.col("src").alias("root"), F.col("dst").alias("node")) if roots is None else step.join(roots, step.src == roots.root, "left_semi").select(F.col("src").alias("root"), F.col("dst").alias("node"))
    seen = front = first.where("root != node").withColumn("hops", F.lit(1).cast("bigint"))
    for k in range(2, depth + 1):
        new = front.join(step, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).where("root != node").distinct()
        front = cut(new.join(seen, ["root", "node"], "left_anti").withColumn("hops", F.lit(k).cast("bigint")))
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen


def paths(edges: DataFrame, depth: int, roots: DataFrame | None = None) -> DataFrame:
    """(src, dst, path, hops, risk) of all simple paths of up to depth edges; risk is their weights' sum."""
    first = edges if roots is None else edges.join(roots, edges.src == roots.root, "left_semi")
    level = first.where("src != dst").select("src", "dst", F.array("src", "dst").alias("path"), F.col("weight").alias("risk"))
    found = [level]
    hop = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("weight").alias("_w"))
    for _ in range(depth - 1):
        level = level.join(hop, F.col("dst") == F.col("_s")).where(~F.array_contains("path", F.col("_d"))).select("src", F.col("_d").alias("dst"), F.concat("path", F.array("_d")).alias("path"), (F.col("risk") + F.col("_w")).alias("risk"))
        found.append(level)
    return reduce(DataFrame.unionAll, found).select("src", "dst", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), (F.size("path") - 1).cast("bigint").alias("hops"), F.round("risk", 6).alias("risk"))


def riskiest(edges: DataFrame, depth: int = 3, k: int = 2) -> DataFrame:
    """The k riskiest simple paths from each node."""
    w = W.partitionBy("src").orderBy(F.desc("risk"), "path")
    return paths(edges, depth).withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k)


def scored_paths(edges: DataFrame, depth: int = 3) -> DataFrame:
    """Paths from node 0 with 0.5 more for a privileged end and 0.05 less a node, 0 at least."""
    root = edges.sparkSession.range(1).select(F.col("id").cast("int").alias("root"))
    p = paths(edges, depth, root)
    score = F.greatest(F.col("risk") + F.when(F.col("dst") % 5 == 0, 0.5).otherwise(0.0) - 0.05 * (F.col("hops") + 1), F.lit(0.0))
    return p.select("dst", "path", "hops", F.round(score, 6).alias("score"))


def choke_points(edges: DataFrame, depth: int = 3, share: float = 0.05) -> DataFrame:
    """Nodes inside at least a share of all paths, with the share."""
    p = paths(edges, depth).where("hops > 1").select(F.split("path", ">").alias("p"))
    total = p.agg(F.count("*").alias("total"))
    inner = p.select(F.explode(F.slice("p", F.lit(2), F.size("p") - 2)).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    return inner.crossJoin(F.broadcast(total)).where(F.col("n") >= share * F.col("total")).select("node", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


def distances(edges: DataFrame, source: int) -> DataFrame:
    """(node, cost) of the cheapest way from a node, an edge costing 1 / weight; parallel edges count by the cheapest.

    Only nodes whose cost fell in a round are relaxed in the next, until none falls (costs are positive, so that ends).
    """
    e = edges.groupBy("src", "dst").agg(F.min(F.round(1.0 / F.col("weight"), 6)).alias("c"))
    best = fallen = edges.sparkSession.createDataFrame([(source, 0.0)], "node int, cost double")
    while not fallen.isEmpty():
        step = fallen.join(e, fallen.node == e.src).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("c")).alias("new"))
        both = cut(best.join(step, "node", "full").select("node", F.least("cost", "new").alias("cost"), (F.col("cost").isNull() | (F.col("new") < F.col("cost"))).alias("fell")))
        best, fallen = both.select("node", "cost"), both.where("fell").select("node", "cost")
    return best.select("node", F.round("cost", 6).alias("cost"))


def blast_radius(edges: DataFrame, depth: int = 3) -> DataFrame:
    """How many nodes each node reaches by tier, and a score of at most 1 from their mean and largest risk ((node mod 7) / 10)."""
    r = reach(edges, depth).withColumn("risk", (F.col("node") % 7) / 10.0)
    score = F.least(F.lit(1.0), 0.6 * F.avg("risk") + 0.4 * F.max("risk"))
    a = r.groupBy("root").agg(*(F.count(F.when(F.col("hops") == k, 1)).alias(f"tier{k}") for k in range(1, depth + 1)), F.count("*").alias("n"), F.round(score, 6).alias("score"))
    return a.withColumn("severity", F.when(F.col("score") >= 0.45, "high").when(F.col("score") >= 0.35, "medium").otherwise("low"))


def containment(edges: DataFrame, root: int, depth: int = 3, k: int = 5) -> DataFrame:
    """The k nodes of largest out degree among those a node reaches."""
    roots = edges.sparkSession.createDataFrame([(root,)], "root int")
    return degrees(edges).join(reach(edges, depth, roots).select("node"), "node", "left_semi").orderBy(F.desc("out_degree"), "node").limit(k).select("node", "out_degree")


def _spread(labels: DataFrame, step: DataFrame) -> DataFrame:
    """(node, label) with every node's smallest label among those of all nodes that reach it over step (src, dst); only fallen labels travel on."""
    fallen = labels
    while not fallen.isEmpty():
        got = fallen.join(step, fallen.node == step.src).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("new"))
        both = cut(labels.join(got, "node", "left").select("node", F.least("label", "new").alias("label"), F.coalesce(F.col("new") < F.col("label"), F.lit(False)).alias("fell")))
        labels, fallen = both.select("node", "label"), both.where("fell").select("node", "label")
    return labels


def followed(step: DataFrame, inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each of inner(node), which have one way out each over step (src, dst), comes out: (node, end), and rings: (node, least), of those that never do.

    Ways are doubled each round, and only those that are still inside go on, so a way of n nodes takes about log2(n) rounds.
    """
    n, inside = inner.count(), inner.select(F.col("node").alias("end"), F.lit(True).alias("open"))
    told = lambda rows: cut(rows.join(inside, "end", "left").select("node", "end", "least", F.coalesce("open", F.lit(False)).alias("open")))
    moving = told(step.join(inner, step.src == inner.node, "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("end"), F.col("src").alias("least")))
    out = moving.where("not open")
    for _ in range(n.bit_length()):
        on = out.unionAll(moving.where("open")).select(F.col("node").alias("end"), F.col("end").alias("next"), F.col("least").alias("other"))
        moving = told(moving.where("open").join(on, "end").select("node", F.col("next").alias("end"), F.least("least", "other").alias("least")))
        out = out.unionAll(moving.where("not open"))
        if moving.where("open").isEmpty():
            break
    return out.select("node", "end"), moving.where("open").select("node", "least")


def cycles(edges: DataFrame) -> DataFrame:
    """Strong components of more than one node, of any width: (node, component: its least node, size).

    Nodes with one way in and one way out are followed to where their way begins and ends (by doubling), and an edge stands for the way; so long chains and
    rings cost few rounds. They belong to a component if both its ends do.
    """
    step = cut(edges.where("src != dst").select("src", "dst").distinct())
    ins, outs = step.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")), step.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    inner = cut(ins.where("n = 1").join(outs.where("n = 1"), "node", "left_semi").select("node"))
    if inner.isEmpty():
        return _coloured(step)
    ends, rings = followed(step, inner)
    begins, _ = followed(step.select(F.col("dst").alias("src"), F.col("src").alias("dst")), inner)
    ends = cut(ends)
    ways = cut(begins.select("node", F.col("end").alias("begin")).join(ends, "node"))
    outer = step.join(inner.select(F.col("node").alias("src")), "src", "left_anti")
    short = outer.join(ends.select(F.col("node").alias("dst"), "end"), "dst", "left").select("src", F.coalesce("end", "dst").alias("dst"))
    short = cut(short.join(rings.select(F.col("node").alias("dst")), "dst", "left_anti"))
    found = cut(_coloured(short.where("src != dst")).select("node", "component"))
    loops = short.where("src = dst").select(F.col("src").alias("node")).join(found, "node", "left_anti").distinct()
    found = found.unionAll(loops.select("node", F.col("node").alias("component")))
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
    between = ways.join(of("begin"), "begin").join(of("end"), "end").where("begin_component = end_component").select("node", F.col("begin_component").alias("component"))
    all_found = cut(found.unionAll(between).unionAll(rings.select("node", F.col("least").alias("component"))))
    sizes = all_found.groupBy("component").agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1")
    return all_found.join(sizes, "component").select("node", F.col("least").alias("component"), "size")


def _coloured(step: DataFrame) -> DataFrame:
    """Strong components of step (src, dst) by colouring.

    Every node takes the smallest node that reaches it as its colour; going backwards within a colour from that node
    gives that node's component. What is found goes, and edges between colours, which no component crosses; the rest is coloured again.
    No closure of all pairs is ever written.
    """
    edges = step
    found: list[DataFrame] = []
    while not step.isEmpty():
        nodes = step.select(F.col("src").alias("node")).union(step.select("dst")).distinct()
        colour = _spread(nodes.withColumn("label", F.col("node")), step)
        of = lambda end: colour.select(F.col("node").alias(end), F.col("label").alias(f"{end}_colour"))
        within = cut(step.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")))
        back = within.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        start = within.select(F.col("src").alias("node"), "colour").union(within.select("dst", "colour")).distinct()
        seen = _spread(start.select("node", F.when(F.col("node") == F.col("colour"), 0).otherwise(1).alias("label")), back)
        part = cut(seen.where("label = 0").join(start, "node").select("node", F.col("colour").alias("component")))
        found.append(part)
        gone = part.select("node")
        step = cut(within.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if not found:
        return edges.where("false").select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(0).cast("bigint").alias("size"))
    all_found = reduce(DataFrame.unionAll, found)
    return all_found.join(all_found.groupBy("component").agg(F.count("*").alias("size")).where("size > 1"), "component").select("node", "component", "size")


def exposure(edges: DataFrame, jewel: int, depth: int = 8) -> DataFrame:
    """Risk of every node that reaches a jewel: 1 less 0.15 a hop, 0 at least."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    roots = edges.sparkSession.createDataFrame([(jewel,)], "root int")
    return reach(back, depth, roots).select("node", "hops", F.round(F.greatest(F.lit(0.0), 1 - 0.15 * F.col("hops")), 6).alias("risk"))


def _settled(risk: DataFrame, turn, rounds: int, every: int = 5, least: float = 1e-6) -> DataFrame:
    """risk (node, base, risk) after turns, until the largest change of a turn that ends a run of `every` is below least, or rounds are done."""
    for _ in range(0, rounds, every):
        for _ in range(every):
            risk = turn(risk)
        risk = cut(risk)
        if (risk.agg(F.max(F.abs(F.col("risk") - F.col("old")))).first()[0] or 0.0) < least:
            break
    return risk.select("node", F.round("risk", 6).alias("risk"))


def _based(edges: DataFrame) -> DataFrame:
    base = (F.col("node") % 7) / 10.0
    return cut(edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct().select("node", base.alias("base"), base.alias("risk")))


def propagated(edges: DataFrame, damping: float = 0.85, rounds: int = 100) -> DataFrame:
    """(1 - d) * base + d * sum of parents' risk by their weights' shares, clamped to 1, until it changes by less than 1e-6 (looked at
    every fifth round), at most rounds; base is (node mod 7) / 10."""
    share = cut(edges.withColumn("p", F.col("weight") / F.sum("weight").over(W.partitionBy("src"))).select("src", "dst", "p"))

    def turn(risk: DataFrame) -> DataFrame:
        flow = risk.select(F.col("node").alias("src"), F.col("risk").alias("r")).join(share, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("r") * F.col("p")).alias("x"))
        new = F.least(F.lit(1.0), (1 - damping) * F.col("base") + damping * F.coalesce("x", F.lit(0.0)))
        return risk.join(flow, "node", "left").select("node", "base", new.alias("risk"), F.col("risk").alias("old"))

    return _settled(_based(edges), turn, rounds)


def noisy_or(edges: DataFrame, damping: float = 0.8, rounds: int = 10) -> DataFrame:
    """Each round a node's risk becomes 1 - (1 - base) * product of (1 - damping * parent * weight / 2), until it changes by less than 1e-6
    (looked at every fifth round), at most rounds."""

    def turn(risk: DataFrame) -> DataFrame:
        flow = risk.select(F.col("node").alias("src"), F.col("risk").alias("r")).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.log(1 - damping * F.col("r") * F.col("weight") / 2)).alias("x"))
        new = 1 - (1 - F.col("base")) * F.exp(F.coalesce("x", F.lit(0.0)))
        return risk.join(flow, "node", "left").select("node", "base", new.alias("risk"), F.col("risk").alias("old"))

    return _settled(_based(edges), turn, rounds)


def access_edges(ev: DataFrame) -> DataFrame:
    """Edges of events that succeeded: actor to role and role to resource for privileged ones, else actor to resource."""
    actor, role = F.concat(F.lit("u"), F.col("actor").cast("string")), F.concat(F.lit("role"), (F.col("actor") % 5).cast("string"))
    edge = lambda a, b, t: F.struct(a.alias("src"), b.alias("dst"), F.lit(t).alias("kind"))
    made = F.when(F.col("action") == "purchase", F.array(edge(actor, role, "permission"), edge(role, F.col("resource"), "permission"))).otherwise(F.array(edge(actor, F.col("resource"), "accessed")))
    return ev.where("action != 'error'").select("us", F.explode(made).alias("e")).select("us", "e.*")


def lifecycle(ev: DataFrame) -> DataFrame:
    """Edges with count, first and last use, and whether they lasted out their time to live before the end of the data."""
    e = access_edges(ev).groupBy("src", "dst", "kind").agg(F.count("*").alias("n"), F.min("us").alias("born_us"), F.max("us").alias("last_us"))
    now = ev.agg(F.max("us").alias("now"))
    ttl = F.when(F.col("kind") == "permission", 18 * DAY).otherwise(9 * DAY)
    return e.crossJoin(F.broadcast(now)).select("src", "dst", "kind", "n", "born_us", "last_us", (F.col("last_us") + ttl >= F.col("now")).alias("active"))


def privileges(ev: DataFrame) -> DataFrame:
    """Each actor's largest privilege over what it reaches in two hops (a resource's is its number mod 10), and how many of 7 or more."""
    e = access_edges(ev).select("src", "dst").distinct()
    two = e.where("src like 'u%'").select(F.col("src").alias("actor"), "dst").unionAll(e.where("src like 'u%'").select(F.col("src").alias("actor"), F.col("dst").alias("mid")).join(e, F.col("mid") == F.col("src")).select("actor", "dst")).distinct()
    level = F.regexp_extract("dst", "res-([0-9]+)", 1).try_cast("bigint") % 10
    return two.where("dst like 'res-%'").groupBy("actor").agg(F.max(level).alias("privilege"), F.count(F.when(level >= 7, 1)).alias("n_high"))


def on_trade(found: dict[str, tuple]) -> dict:
    """Queries from (function, arguments) on all pairs of nations. Edges are made once. SMALL has them on each nation's three strongest edges, as a fixture."""
    made = lambda k: {name: lambda s, d, f=f, a=a: f(cut(trade(s, d, k)), *a) for name, (f, *a) in found.items()}
    SMALL.update(made(3))
    return made(None)


#: For tests.
SMALL: dict = {}


QUERIES = {
    "g1_access_edges": lambda s, d: access_edges(events(s, d)).groupBy("src", "dst", "kind").agg(F.count("*").alias("n")),
    "g2_lifecycle": lambda s, d: lifecycle(events(s, d)),
    "g4_privileges": lambda s, d: privileges(events(s, d)),
} | on_trade({
    "g9_degrees": (degrees,),
    "g10_density": (density,),
    "t1_reach": (reach, 3),
    "t5_paths": (paths, 3),
    "t9_distances": (distances, 0),
    "t10_scored_paths": (scored_paths,),
    "t11_riskiest": (riskiest,),
    "t12_choke_points": (choke_points,),
    "t13_blast_radius": (blast_radius,),
    "t15_containment": (containment, 0),
    "t17_cycles": (cycles,),
    "t18_exposure": (exposure, 3),
    "r11_propagated": (propagated,),
    "r14_noisy_or": (noisy_or,),
})

#: What leaves each nation its three strongest edges.
STRONGEST = " WHERE place <= 3"
_TRADE = """WITH RECURSIVE tr AS (SELECT src, dst, round(1.0 / place, 6)::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS place FROM (SELECT c_nationkey AS src, s_nationkey AS dst,
 round(CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 2))) AS DOUBLE) / any_value(n), 2) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) ON k = s_nationkey
 WHERE c_nationkey <> s_nationkey GROUP BY 1, 2))""" + STRONGEST + ")"
_DEG = """, dg AS (SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM tr UNION ALL SELECT dst, 0, 1 FROM tr) GROUP BY node)"""


def _paths(depth: int, where: str = "true") -> str:
    return f""", ps AS (SELECT src, dst, [src, dst] AS p, weight AS risk FROM tr WHERE {where} UNION ALL SELECT ps.src, tr.dst, list_append(p, tr.dst), risk + weight FROM ps JOIN tr ON ps.dst = tr.src WHERE NOT list_contains(p, tr.dst) AND len(p) <= {depth}),
 pa AS (SELECT src, dst, array_to_string(p, '>') AS path, CAST(len(p) - 1 AS BIGINT) AS hops, round(risk, 6) AS risk FROM ps)"""


def _reach(depth: int, edges: str = "tr", where: str = "true") -> str:
    return f""", rr AS (SELECT src AS root, dst AS node, 1 AS h FROM {edges} WHERE {where} UNION SELECT rr.root, e.dst, h + 1 FROM rr JOIN {edges} e ON rr.node = e.src WHERE h < {depth}), rc AS (SELECT root, node, CAST(min(h) AS BIGINT) AS hops FROM rr WHERE root <> node GROUP BY ALL)"""


def _closed(edges: str = "tr") -> str:
    return f""", rc AS (SELECT src AS root, dst AS node FROM {edges} UNION SELECT rc.root, e.dst FROM rc JOIN {edges} e ON rc.node = e.src)"""


_ACCESS = EV + """, ac AS (SELECT us, 'u' || actor AS src, 'role' || (actor % 5) AS dst, 'permission' AS kind FROM ev WHERE action = 'purchase' UNION ALL SELECT us, 'role' || (actor % 5), resource, 'permission' FROM ev WHERE action = 'purchase' UNION ALL SELECT us, 'u' || actor, resource, 'accessed' FROM ev WHERE action NOT IN ('purchase', 'error'))"""
_PROP = ", rk AS (SELECT node, (node % 7) / 10.0 AS base FROM (SELECT src AS node FROM tr UNION SELECT dst FROM tr)), sh AS (SELECT src, dst, weight, weight / sum(weight) OVER (PARTITION BY src) AS p FROM tr)"


def _settle(rounds: int, flow: str, new: str) -> str:
    return f""", st AS (SELECT 0 AS k, node, CAST(base AS DOUBLE) AS base, CAST(base AS DOUBLE) AS risk, CAST(1 AS DOUBLE) AS change FROM rk
 UNION ALL SELECT k + 1, node, base, risk, max(abs(risk - old)) OVER () FROM (SELECT k, node, base, {new} AS risk, risk AS old FROM st LEFT JOIN (SELECT dst, {flow} AS x FROM st JOIN sh ON node = src GROUP BY dst) f ON f.dst = st.node WHERE k < {rounds} AND NOT (k % 5 = 0 AND change < 1e-6)))
 SELECT node, round(risk, 6) AS risk FROM st WHERE k = (SELECT max(k) FROM st)"""


ORACLE = {
    "g1_access_edges": _ACCESS + " SELECT src, dst, kind, count(*) AS n FROM ac GROUP BY ALL",
    "g2_lifecycle": _ACCESS + f" SELECT src, dst, kind, count(*) AS n, min(us) AS born_us, max(us) AS last_us, max(us) + CASE WHEN kind = 'permission' THEN {18 * DAY} ELSE {9 * DAY} END >= (SELECT max(us) FROM ev) AS active FROM ac GROUP BY src, dst, kind",
    "g4_privileges": _ACCESS + """, e AS (SELECT DISTINCT src, dst FROM ac), two AS (SELECT src AS actor, dst FROM e WHERE src LIKE 'u%' UNION SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src LIKE 'u%'), l AS (SELECT actor, CAST(replace(dst, 'res-', '') AS BIGINT) % 10 AS l FROM two WHERE dst LIKE 'res-%')
 SELECT actor, max(l) AS privilege, count(*) FILTER (l >= 7) AS n_high FROM l GROUP BY actor""",
    "g9_degrees": _TRADE + _DEG + " SELECT node, out_degree, in_degree, round((out_degree + in_degree) / (2.0 * greatest((SELECT count(*) FROM dg) - 1, 1)), 6) AS centrality FROM dg",
    "g10_density": _TRADE + _DEG + " SELECT count(*) AS nodes, CAST(sum(out_degree) AS BIGINT) AS edges, count(*) FILTER (in_degree = 0) AS no_in, count(*) FILTER (out_degree = 0) AS no_out, round(sum(out_degree) / (count(*) * (count(*) - 1.0)), 6) AS density FROM dg",
    "t1_reach": _TRADE + _reach(3) + " SELECT * FROM rc",
    "t5_paths": _TRADE + _paths(3) + " SELECT * FROM pa",
    "t9_distances": _TRADE + """, dj AS (SELECT 0 AS k, 0::INTEGER AS node, 0.0::DOUBLE AS cost UNION ALL SELECT k + 1, node, min(cost) FROM (SELECT k, node, cost FROM dj UNION ALL SELECT k, dst, cost + round(1.0 / weight, 6) FROM dj JOIN tr ON node = src)
 WHERE k < (SELECT count(*) FROM nation) GROUP BY k, node) SELECT node, round(cost, 6) AS cost FROM dj WHERE k = (SELECT max(k) FROM dj)""",
    "t10_scored_paths": _TRADE + _paths(3, "src = 0") + " SELECT dst, path, hops, round(greatest(risk + CASE WHEN dst % 5 = 0 THEN 0.5 ELSE 0 END - 0.05 * (hops + 1), 0), 6) AS score FROM pa",
    "t11_riskiest": _TRADE + _paths(3) + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY risk DESC, path) AS place FROM pa) WHERE place <= 2",
    "t12_choke_points": _TRADE + _paths(3) + """, ip AS (SELECT unnest(p[2:len(p) - 1]) AS node FROM ps WHERE len(p) > 2), tt AS (SELECT count(*) AS total FROM pa WHERE hops > 1)
 SELECT CAST(node AS VARCHAR) AS node, count(*) AS n, round(100.0 * count(*) / any_value(total), 1)::DOUBLE AS pct FROM ip, tt GROUP BY node HAVING count(*) >= 0.05 * any_value(total)""",
    "t13_blast_radius": _TRADE + _reach(3) + """, bl AS (SELECT root, count(*) FILTER (hops = 1) AS tier1, count(*) FILTER (hops = 2) AS tier2, count(*) FILTER (hops = 3) AS tier3, count(*) AS n, round(least(1.0, 0.6 * avg((node % 7) / 10.0) + 0.4 * max((node % 7) / 10.0)), 6)::DOUBLE AS score FROM rc GROUP BY root)
 SELECT *, CASE WHEN score >= 0.45 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END AS severity FROM bl""",
    "t15_containment": _TRADE + _DEG + _reach(3, where="src = 0") + " SELECT node, out_degree FROM dg WHERE node IN (SELECT node FROM rc) ORDER BY out_degree DESC, node LIMIT 5",
    "t17_cycles": _TRADE + _closed() + " SELECT a.root AS node, min(a.node) AS component, count(*) AS size FROM rc a JOIN rc b ON a.root = b.node AND a.node = b.root GROUP BY a.root HAVING count(*) > 1",
    "t18_exposure": _TRADE + ", bk AS (SELECT dst AS src, src AS dst FROM tr)" + _reach(8, "bk", "src = 3") + " SELECT node, hops, round(greatest(0, 1 - 0.15 * hops), 6)::DOUBLE AS risk FROM rc",
    "r11_propagated": _TRADE + _PROP + _settle(100, "sum(risk * p)", "least(1.0, 0.15 * base + 0.85 * coalesce(x, 0))"),
    "r14_noisy_or": _TRADE + _PROP + _settle(10, "sum(ln(1 - 0.8 * risk * weight / 2))", "1 - (1 - base) * exp(coalesce(x, 0))"),
}
