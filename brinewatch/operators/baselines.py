"""Behaviour baselines, drift, and risk scores of identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brinewatch.operators import graphs, windows as win
from brinewatch.sources.tables import DAY, EV, events, read

FEATURES = ("value", "hour", "k")


def long_form(ev: DataFrame) -> DataFrame:
    """(actor, event_id, us, feature, x): one row per event and feature."""
    pairs = F.array(*(F.struct(F.lit(n).alias("feature"), c.cast("double").alias("x")) for n, c in (("value", F.col("value")), ("hour", F.hour("ts")), ("k", F.col("k")))))
    return ev.select("actor", "event_id", "us", F.explode(pairs).alias("p")).select("actor", "event_id", "us", "p.*")


def baseline(ev: DataFrame, digits: int | None = 6) -> DataFrame:
    """Mean and population variance of each actor's features, unrounded where digits is None."""
    kept = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    return long_form(ev).groupBy("actor", "feature").agg(F.count("*").alias("n"), kept(F.avg("x")).alias("mean"), kept(F.var_pop("x")).alias("variance"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two baselines as one, by the parallel formula; a feature of one side only stays as it is."""
    one = a.select("actor", "feature", F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("variance").alias("v1"))
    two = b.select("actor", "feature", F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("variance").alias("v2"))
    j = one.join(two, ["actor", "feature"], "full").fillna(0)
    n = F.col("n1") + F.col("n2")
    mean = (F.col("n1") * F.col("m1") + F.col("n2") * F.col("m2")) / n
    var = (F.col("n1") * F.col("v1") + F.col("n2") * F.col("v2") + F.pow(F.col("m2") - F.col("m1"), 2) * F.col("n1") * F.col("n2") / n) / n
    return j.select("actor", "feature", n.alias("n"), F.round(mean, 9).alias("mean"), F.round(var, 7).alias("variance"))


def merged_halves(ev: DataFrame) -> DataFrame:
    """A baseline updated: of even events, then of odd ones."""
    return merged(baseline(ev.where("event_id % 2 = 0"), None), baseline(ev.where("event_id % 2 = 1"), None))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std < 1e-9, 0.0).otherwise((x - mean) / std)


def ladder(score: Column, limit: float) -> Column:
    """Severity by shares .5, .8, 1 and 1.5 of the limit."""
    return F.when(score <= 0.5 * limit, "none").when(score <= 0.8 * limit, "low").when(score <= limit, "medium").when(score <= 1.5 * limit, "high").otherwise("critical")


def drift(ev: DataFrame, limit: float = 2.5) -> DataFrame:
    """Each event against its actor's earlier ones: z of every feature, their length, severity; unsure under ten earlier events."""
    w = W.partitionBy("actor", "feature").orderBy("us", "event_id").rowsBetween(W.unboundedPreceding, -1)
    x = long_form(ev).select("actor", "event_id", "x", F.count("x").over(w).alias("n"), F.avg("x").over(w).alias("m"), F.stddev_pop("x").over(w).alias("s")).where("n > 0")
    z = x.withColumn("z", zscore(F.col("x"), F.col("m"), F.col("s"))).groupBy("actor", "event_id").agg(F.min("n").alias("n"), F.round(F.sqrt(F.sum(F.col("z") * F.col("z"))), 5).alias("score"))
    return z.select("actor", "event_id", "score", (F.col("n") < 10).alias("unsure"), ladder(F.col("score"), limit).alias("severity"))


def vector_drift(vectors: DataFrame, limit: float = 0.35) -> DataFrame:
    """L2 and cosine distance of each vector to its label's mean."""
    dims = vectors.select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    mean = dims.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("c"))  # a vector per label: bounded by its dimensions
    v = vectors.join(centre, "label").withColumn("e", F.col("embedding").cast("array<double>"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    ee, cc, ec = dot(F.col("e"), F.col("e")), dot(F.col("c"), F.col("c")), dot(F.col("e"), F.col("c"))
    return v.select("vec_id", "label", F.round(F.sqrt(F.greatest(ee + cc - 2 * ec, F.lit(0.0))), 4).alias("l2"), F.round(1 - ec / F.sqrt(ee * cc), 4).alias("cosine")).withColumn("drifting", F.col("cosine") > limit)


def envelope(ev: DataFrame) -> DataFrame:
    """How far each actor's mean value lies outside soft (1 sigma of all actors) and hard (2 sigma) limits."""
    a = ev.groupBy("actor").agg(F.avg("value").alias("m"))
    s = a.agg(F.avg("m").alias("mm"), F.stddev_pop("m").alias("ss"))
    z = F.abs(F.col("m") - F.col("mm")) / F.col("ss")
    return a.crossJoin(F.broadcast(s)).select("actor", F.round(z, 5).alias("z"), F.when(z > 2, "hard").when(z > 1, "soft").otherwise("inside").alias("band"))


def versions(ev: DataFrame) -> DataFrame:
    """Daily versions of each action's mean value: version number, change to the one before, whether it is the latest."""
    d = ev.groupBy("action", F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("m"))
    w = W.partitionBy("action").orderBy("day")
    return d.select("action", F.row_number().over(w).cast("bigint").alias("version"), F.round("m", 5).alias("mean"), F.round(F.col("m") - F.lag("m").over(w), 5).alias("change"), (F.row_number().over(W.partitionBy("action").orderBy(F.desc("day"))) == 1).alias("latest"))


TIERS = ((80, "critical"), (60, "high"), (35, "medium"), (15, "low"))


def tier(score: Column) -> Column:
    out = F.lit("minimal")
    for cut, name in reversed(TIERS):
        out = F.when(score >= cut, name).otherwise(out)
    return out


def identity_risk(ev: DataFrame) -> DataFrame:
    """Identity and velocity dimensions of each actor, their mix and tier."""
    a = ev.groupBy("actor").agg(F.count("*").alias("n"), F.countDistinct("resource").alias("resources"), F.countDistinct("action").alias("actions"), F.count(F.when(F.col("action") == "error", 1)).alias("errors"), F.count(F.when(F.col("action") == "purchase", 1)).alias("privileged"))
    a = a.join(win.hour_peaks(ev).select("actor", "peak"), "actor").join(win.entropy(ev, ["actor"], "resource").select("actor", "entropy"), "actor")
    flags = F.when(F.col("errors") >= 3, 1).otherwise(0) + F.when(F.col("privileged") >= 3, 1).otherwise(0) + F.when(F.col("peak") >= 3, 1).otherwise(0)
    footprint = F.log1p("resources") * F.log1p("actions")
    identity = F.least(F.lit(100.0), F.least(F.lit(60.0), 12.0 * flags) + F.least(F.lit(30.0), 8 * footprint) + F.least(F.lit(20.0), 5 * F.col("entropy")) + F.least(F.lit(15.0), 2.5 * F.log1p("n")))
    speed = F.least(F.lit(60.0), 10 * F.log1p("peak"))
    score = 0.7 * identity + 0.3 * speed
    return a.select("actor", "n", flags.cast("bigint").alias("flags"), F.round(identity, 4).alias("identity"), F.round(speed, 4).alias("velocity"), F.round(score, 4).alias("score"), tier(score).alias("tier"))


def graph_risk(edges: DataFrame) -> DataFrame:
    """Degrees as risk, with a factor by kind of node."""
    d = graphs.degrees(edges)
    x = 0.6 * F.least(F.lit(50.0), 12 * F.log1p("out_degree")) + 0.4 * F.least(F.lit(40.0), 8 * F.log1p("in_degree"))
    return d.select("node", F.round(x * (1 + (F.col("node") % 3) * 0.25), 4).alias("risk"))


SIGNALS = {"a": 0.5, "b": 0.3, "c": 0.2}


def calibrated(ev: DataFrame) -> DataFrame:
    """Signals per actor clamped to 0 .. 1 and averaged by the weights of those there are; the strongest one is named."""
    s = ev.groupBy("actor").agg(*(F.least(F.avg(F.when(F.col("action") == act, F.col("value"))) / 30, F.lit(1.0)).alias(n) for n, act in zip(SIGNALS, ("error", "purchase", "signup"), strict=True)))
    have = sum((F.when(F.col(n).isNotNull(), w).otherwise(0.0) for n, w in SIGNALS.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) * w for n, w in SIGNALS.items()), F.lit(0.0))
    parts = {n: F.coalesce(F.col(n) * w, F.lit(-1.0)) for n, w in SIGNALS.items()}
    top = F.greatest(*parts.values())
    named = F.coalesce(*(F.when(p == top, n) for n, p in parts.items()))
    return s.where("a is not null or b is not null or c is not null").select("actor", F.round(total / have, 5).alias("score"), F.round(have, 5).alias("confidence"), named.alias("dominant"))


def trend(ev: DataFrame) -> DataFrame:
    """The last ten values of each actor: their first three against their last three."""
    w = W.partitionBy("actor").orderBy(F.desc("us"), F.desc("event_id"))
    x = ev.withColumn("r", F.row_number().over(w)).where("r <= 10").withColumn("m", F.max("r").over(W.partitionBy("actor")))
    a = x.groupBy("actor").agg(F.avg(F.when(F.col("r") > F.col("m") - 3, F.col("value"))).alias("old"), F.avg(F.when(F.col("r") <= 3, F.col("value"))).alias("new"), F.count("*").alias("n")).where("n >= 6")
    d = F.col("new") - F.col("old")
    return a.select("actor", F.round(d, 5).alias("change"), F.when(d > 0.05, "rising").when(d < -0.05, "falling").otherwise("stable").alias("trend"))


def decayed(ev: DataFrame, half: int = 5 * DAY) -> DataFrame:
    """Each actor's mean value with weights that halve every five days before its last event."""
    last = F.max("us").over(W.partitionBy("actor"))
    wt = F.exp(-F.log(F.lit(2.0)) * (F.col("last") - F.col("us")) / half)
    return ev.withColumn("last", last).groupBy("actor").agg(F.round(F.sum(F.col("value") * wt) / F.sum(wt), 5).alias("mean"))


def system_risk(ev: DataFrame) -> DataFrame:
    """Over actors' scores: weighted mean, the 80th percentile, how many are above it, and five half-open bins, the last one closed."""
    r = identity_risk(ev).select("actor", (F.col("score") / 100).alias("r"))
    p = r.agg(F.percentile("r", 0.8).alias("p80"))
    wt = F.when(F.col("actor") % 10 == 0, 10.0).otherwise(2.0)
    return r.crossJoin(F.broadcast(p)).agg(F.round(F.sum(F.col("r") * wt) / F.sum(wt), 5).alias("mean"), F.round(F.first("p80"), 5).alias("p80"), F.count(F.when(F.col("r") > F.col("p80"), 1)).alias("n_high"), *(F.count(F.when((F.col("r") >= i / 5) & (F.col("r") < ((i + 1) / 5 if i < 4 else 1.1)), 1)).alias(f"bin{i}") for i in range(5)))


def mitigation(ev: DataFrame, budget: float = 2.0) -> DataFrame:
    """Greedy plan: actors of risk over .3 by risk, cost .3 of it or what is left, reduction twice the cost.

    Costs are summed within bands of a hundredth of risk, each on top of what the riskier bands cost, so no task orders all actors.
    """
    r = identity_risk(ev).select("actor", (F.col("score") / 100).alias("risk")).where("risk > 0.3").withColumn("band", F.floor(F.col("risk") * 100))
    above = F.sum("c").over(W.orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, -1))
    bands = r.groupBy("band").agg(F.sum(0.3 * F.col("risk")).alias("c")).select("band", F.coalesce(above, F.lit(0.0)).alias("before"))  # 70 rows at most
    w = W.partitionBy("band").orderBy(F.desc("risk"), "actor").rowsBetween(W.unboundedPreceding, -1)
    r = r.join(F.broadcast(bands), "band")
    left = F.lit(budget) - F.col("before") - F.coalesce(F.sum(0.3 * F.col("risk")).over(w), F.lit(0.0))
    x = r.withColumn("left", left).where("left > 1e-9").withColumn("cost", F.least(0.3 * F.col("risk"), F.col("left")))
    return x.select("actor", F.round("cost", 5).alias("cost"), F.round(2 * F.col("cost"), 5).alias("reduction"))


def _e(f, *a):
    return lambda s, d: f(events(s, d), *a)


QUERIES = {
    "identity_risk": _e(identity_risk),
    "bl1_baseline": _e(baseline), "bl3_merged": _e(merged_halves), "bl5_drift": _e(drift), "bl7_vector_drift": lambda s, d: vector_drift(read(s, d, "embeddings")), "bl8_envelope": _e(envelope), "bl10_versions": _e(versions),
    **graphs.on_trade({"r4_graph_risk": (graph_risk,)}), "r7_calibrated": _e(calibrated), "r8_trend": _e(trend), "r9_decayed": _e(decayed), "r15_system_risk": _e(system_risk), "r16_mitigation": _e(mitigation),
}

_LONG = EV + ", lf AS (SELECT actor, event_id, us, 'value' AS feature, value AS x FROM ev UNION ALL SELECT actor, event_id, us, 'hour', CAST(hour(ts) AS DOUBLE) FROM ev UNION ALL SELECT actor, event_id, us, 'k', CAST(k AS DOUBLE) FROM ev)"
_RISK = EV + """, pk AS (SELECT actor, max(n) AS peak FROM (SELECT actor, date_trunc('hour', ts), count(*) AS n FROM ev GROUP BY ALL) GROUP BY actor), en AS (SELECT actor, round(abs(-sum(p * log2(p))), 6) AS entropy FROM (SELECT actor, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY actor) AS p FROM ev GROUP BY actor, resource) GROUP BY actor),
 ra AS (SELECT ev.actor, count(*) AS n, count(DISTINCT resource) AS resources, count(DISTINCT action) AS actions, any_value(peak) AS peak, any_value(entropy) AS entropy, CASE WHEN count(*) FILTER (action = 'error') >= 3 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (action = 'purchase') >= 3 THEN 1 ELSE 0 END + CASE WHEN any_value(peak) >= 3 THEN 1 ELSE 0 END AS flags FROM ev JOIN pk USING (actor) JOIN en USING (actor) GROUP BY ev.actor),
 rb AS (SELECT *, least(100.0, least(60, 12.0 * flags) + least(30, 8 * ln(1 + resources) * ln(1 + actions)) + least(20, 5 * entropy) + least(15, 2.5 * ln(1 + n))) AS identity, least(60, 10 * ln(1 + peak)) AS velocity FROM ra),
 rs AS (SELECT actor, n, CAST(flags AS BIGINT) AS flags, round(identity, 4) AS identity, round(velocity, 4) AS velocity, round(0.7 * identity + 0.3 * velocity, 4) AS score, CASE WHEN 0.7 * identity + 0.3 * velocity >= 80 THEN 'critical' WHEN 0.7 * identity + 0.3 * velocity >= 60 THEN 'high' WHEN 0.7 * identity + 0.3 * velocity >= 35 THEN 'medium' WHEN 0.7 * identity + 0.3 * velocity >= 15 THEN 'low' ELSE 'minimal' END AS tier FROM rb)"""
_PRIOR = "OVER (PARTITION BY actor, feature ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ORACLE = {
    "identity_risk": _RISK + " SELECT * FROM rs",
    "bl1_baseline": _LONG + " SELECT actor, feature, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance FROM lf GROUP BY ALL",
    "bl3_merged": _LONG + " SELECT actor, feature, count(*) AS n, round(avg(x), 9) AS mean, round(var_pop(x), 7) AS variance FROM lf GROUP BY ALL",
    "bl5_drift": _LONG + f""", p AS (SELECT actor, event_id, x, count(x) {_PRIOR} AS n, avg(x) {_PRIOR} AS m, stddev_pop(x) {_PRIOR} AS s FROM lf), z AS (SELECT actor, event_id, min(n) AS n, round(sqrt(sum(pow(CASE WHEN s < 1e-9 THEN 0 ELSE (x - m) / s END, 2))), 5) AS score FROM p WHERE n > 0 GROUP BY ALL)
 SELECT actor, event_id, score, n < 10 AS unsure, CASE WHEN score <= 1.25 THEN 'none' WHEN score <= 2 THEN 'low' WHEN score <= 2.5 THEN 'medium' WHEN score <= 3.75 THEN 'high' ELSE 'critical' END AS severity FROM z""",
    "bl7_vector_drift": """WITH d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM d GROUP BY ALL),
 s AS (SELECT vec_id, label, sum(x * x) AS ee, sum(m * m) AS cc, sum(x * m) AS ec FROM d JOIN m USING (label, i) GROUP BY ALL) SELECT vec_id, label, round(sqrt(greatest(ee + cc - 2 * ec, 0)), 4) AS l2, round(1 - ec / sqrt(ee * cc), 4) AS cosine, round(1 - ec / sqrt(ee * cc), 4) > 0.35 AS drifting FROM s""",
    "bl8_envelope": EV + ", a AS (SELECT actor, avg(value) AS m FROM ev GROUP BY actor), z AS (SELECT actor, abs(m - (SELECT avg(m) FROM a)) / (SELECT stddev_pop(m) FROM a) AS z FROM a) SELECT actor, round(z, 5) AS z, CASE WHEN z > 2 THEN 'hard' WHEN z > 1 THEN 'soft' ELSE 'inside' END AS band FROM z",
    "bl10_versions": EV + ", d AS (SELECT action, date_trunc('day', ts) AS day, avg(value) AS m FROM ev GROUP BY ALL) SELECT action, row_number() OVER (PARTITION BY action ORDER BY day) AS version, round(m, 5) AS mean, round(m - lag(m) OVER (PARTITION BY action ORDER BY day), 5) AS change, row_number() OVER (PARTITION BY action ORDER BY day DESC) = 1 AS latest FROM d",
    "r4_graph_risk": graphs._TRADE + graphs._DEG + " SELECT node, round((0.6 * least(50, 12 * ln(1 + out_degree)) + 0.4 * least(40, 8 * ln(1 + in_degree))) * (1 + (node % 3) * 0.25), 4) AS risk FROM dg",
    "r7_calibrated": EV + """, s AS (SELECT actor, least(avg(value) FILTER (action = 'error') / 30, 1.0) AS a, least(avg(value) FILTER (action = 'purchase') / 30, 1.0) AS b, least(avg(value) FILTER (action = 'signup') / 30, 1.0) AS c, count(*) FILTER (action = 'error') AS na, count(*) FILTER (action = 'purchase') AS nb, count(*) FILTER (action = 'signup') AS nc FROM ev GROUP BY actor),
 w AS (SELECT actor, CASE WHEN na > 0 THEN a * 0.5 END AS a, CASE WHEN nb > 0 THEN b * 0.3 END AS b, CASE WHEN nc > 0 THEN c * 0.2 END AS c FROM s), t AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE 0.5 END + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END AS h, greatest(coalesce(a, -1), coalesce(b, -1), coalesce(c, -1)) AS g FROM w)
 SELECT actor, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / h, 5) AS score, round(h, 5)::DOUBLE AS confidence, CASE WHEN coalesce(a, -1) = g THEN 'a' WHEN coalesce(b, -1) = g THEN 'b' ELSE 'c' END AS dominant FROM t WHERE h > 0""",
    "r8_trend": EV + """, x AS (SELECT actor, value, row_number() OVER (PARTITION BY actor ORDER BY us DESC, event_id DESC) AS r FROM ev), y AS (SELECT *, max(r) OVER (PARTITION BY actor) AS m FROM x WHERE r <= 10), z AS (SELECT actor, avg(value) FILTER (r <= 3) - avg(value) FILTER (r > m - 3) AS d FROM y GROUP BY actor HAVING count(*) >= 6)
 SELECT actor, round(d, 5) AS change, CASE WHEN d > 0.05 THEN 'rising' WHEN d < -0.05 THEN 'falling' ELSE 'stable' END AS trend FROM z""",
    "r9_decayed": EV + f", x AS (SELECT actor, value, exp(-ln(2) * (max(us) OVER (PARTITION BY actor) - us) / {5 * DAY}) AS w FROM ev) SELECT actor, round(sum(value * w) / sum(w), 5) AS mean FROM x GROUP BY actor",
    "r15_system_risk": _RISK + """, r AS (SELECT actor, score / 100 AS r, CASE WHEN actor % 10 = 0 THEN 10.0 ELSE 2.0 END AS w FROM rs), p AS (SELECT quantile_cont(r, 0.8) AS p80 FROM r)
 SELECT round(sum(r * w) / sum(w), 5) AS mean, round(any_value(p80), 5) AS p80, count(*) FILTER (r > p80) AS n_high, """ + ", ".join(f"count(*) FILTER (r >= {i / 5} AND r < {(i + 1) / 5 if i < 4 else 1.1}) AS bin{i}" for i in range(5)) + " FROM r, p",
    "r16_mitigation": _RISK + """, r AS (SELECT actor, score / 100 AS risk FROM rs WHERE score / 100 > 0.3), l AS (SELECT *, 2.0 - coalesce(sum(0.3 * risk) OVER (ORDER BY risk DESC, actor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM r)
 SELECT actor, round(least(0.3 * risk, lft), 5) AS cost, round(2 * least(0.3 * risk, lft), 5) AS reduction FROM l WHERE lft > 1e-9""",
}
