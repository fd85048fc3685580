"""Exposure, composite risk and its report, signals, typed policies, governed automation, witnesses, baselines kept as a store, feature vectors, cycles of series."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from brinewatch.operators import baselines, escalation, series
from brinewatch.operators.windows import PLACED, placed
from brinewatch.sources.tables import DAY, EV, HOUR, cut, events, read, shared_dir

# The weights of the composite's dimensions.
WEIGHTS = {"identity": 0.35, "exposure": 0.30, "velocity": 0.20, "graph": 0.15}


def exposure(ev: DataFrame, ways: DataFrame | None = None) -> DataFrame:
    """Each actor's exposure dimension: severity by how many hops its roles are from one of high privilege, the distance itself, and whether it touched sensitive resources (k mod 5 = 0)."""
    near = escalation.assumed(ev).join(ways or escalation.ways_up(ev), "k").groupBy("actor").agg((F.min("hops") + 1).alias("hops"))
    a = ev.groupBy("actor").agg(F.max((F.col("k") % 5 == 0).cast("int")).alias("sensitive")).join(near, "actor", "left").withColumn("hops", F.coalesce("hops", F.lit(4)))
    severity = F.when(F.col("hops") <= 1, 100.0).when(F.col("hops") == 2, 75.0).when(F.col("hops") == 3, 50.0).otherwise(25.0)
    score = 0.5 * severity + 0.3 * F.least(F.lit(60.0), (4 - F.least("hops", F.lit(4))) * 15.0) + 0.2 * 30.0 * F.col("sensitive")
    return a.select("actor", "hops", F.col("sensitive").cast("bigint").alias("sensitive"), F.round(score, 4).alias("exposure"))


def composite(ev: DataFrame) -> DataFrame:
    """Identity, exposure, velocity and graph dimensions of each actor as one score with its tier, and the dimension that adds most."""
    one = baselines.identity_risk(ev).select("actor", "identity", "velocity")
    g = ev.groupBy("actor").agg(F.countDistinct("resource").alias("out"))
    g = g.select("actor", F.round(0.6 * F.least(F.lit(50.0), 12 * F.log1p("out")), 4).alias("graph"))
    x = one.join(exposure(ev).select("actor", "exposure"), "actor").join(g, "actor")
    parts = {n: w * F.col(n) for n, w in WEIGHTS.items()}
    score = sum(parts.values(), F.lit(0.0))
    top = F.array_max(F.array(*(F.struct(F.round(p, 6).alias("p"), F.lit(n).alias("n")) for n, p in parts.items())))
    return x.select("actor", *WEIGHTS, F.round(score, 6).alias("score"), baselines.tier(F.round(score, 6)).alias("tier"), top["n"].alias("dominant"))


def risk_report(ev: DataFrame) -> DataFrame:
    """How many identities each tier has, with the mean, the least and the largest score."""
    return composite(ev).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"))


def risk_metrics(ev: DataFrame) -> DataFrame:
    """Mean, median and percentiles of scores, and how many are over the 80th."""
    r = baselines.identity_risk(ev).select("score")
    p = r.agg(*(F.percentile("score", q).alias(n) for n, q in (("median", 0.5), ("p80", 0.8), ("p95", 0.95))), F.avg("score").alias("mean"))
    n = r.crossJoin(F.broadcast(p)).agg(F.count(F.when(F.col("score") > F.col("p80"), 1)).alias("n_high"))
    return p.crossJoin(F.broadcast(n)).select(*(F.round(c, 5).alias(c) for c in ("mean", "median", "p80", "p95")), "n_high")


def aggregated_signals(ev: DataFrame) -> DataFrame:
    """Signals of each actor (value / 200 of errors, purchases and signups with confidence .9, .7 and .5) as their mean by confidence."""
    c = F.when(F.col("action") == "error", 0.9).when(F.col("action") == "purchase", 0.7).when(F.col("action") == "signup", 0.5)
    x = ev.withColumn("c", c).where("c is not null").withColumn("s", F.least(F.col("value") / 200, F.lit(1.0)))
    score = F.least(F.lit(1.0), F.sum(F.col("s") * F.col("c")) / F.sum("c"))
    return x.groupBy("actor").agg(F.count("*").alias("n"), F.round(score, 6).alias("score"))


def feature_distance(ev: DataFrame) -> DataFrame:
    """Euclidean distance between each actor's mean features before and after the middle of its events' span, -1 where a side lacks some, and the digest of what the first half was."""
    mid = ev.groupBy("actor").agg(((F.min("us") + F.max("us")) / 2).alias("mid"))
    x = baselines.long_form(ev).join(mid, "actor").withColumn("half", (F.col("us") > F.col("mid")).cast("int"))
    m = x.groupBy("actor", "feature").agg(*(F.avg(F.when(F.col("half") == h, F.col("x"))).alias(f"m{h}") for h in (0, 1)), F.count(F.when(F.col("half") == 0, 1)).alias("n"))
    lacks = F.max((F.col("m0").isNull() | F.col("m1").isNull()).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("feature", "n"))), lambda e: F.concat(e["feature"], F.lit("="), e["n"].cast("string"))), ";")  # three features
    return m.groupBy("actor").agg(F.when(lacks == 1, -1.0).otherwise(F.round(F.sqrt(F.sum(F.pow(F.col("m1") - F.col("m0"), 2))), 5)).alias("distance"), F.substring(F.sha2(text, 256), 1, 16).alias("digest"))


def stale_baselines(ev: DataFrame, stale: int = 8 * HOUR, expired: int = 24 * HOUR) -> DataFrame:
    """Baselines of resources by when they were last fed: stale or expired at the end of the data."""
    now = ev.agg(F.max("us").alias("now"))
    x = ev.groupBy("resource").agg(F.max("us").alias("last_us")).crossJoin(F.broadcast(now)).withColumn("age", F.col("now") - F.col("last_us"))
    return x.where(F.col("age") > stale).select("resource", "last_us", F.when(F.col("age") > expired, "expired").otherwise("stale").alias("status"))


def soft_limits(ev: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Each action's soft limit over days: it starts at the first day's mean plus half and grows by a share of what a day's mean exceeds it; it never falls, so it is a running fold of a value a day."""
    d = series.daily(ev).groupBy("action").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "x"))), lambda e: e["x"]).alias("v"))
    fold = F.aggregate("v", F.col("v")[0] * 1.5, lambda a, x: a + alpha * F.greatest(x - a, F.lit(0.0)))
    return d.select("action", F.round(F.col("v")[0] * 1.5, 5).alias("first"), F.round(fold, 5).alias("last"), F.size(F.filter("v", lambda x: x > F.col("v")[0] * 1.5)).cast("bigint").alias("breaches"))


def adapted(vectors: DataFrame, alpha: float = 0.05, limit: float = 1.05) -> DataFrame:
    """Each label's baseline vector after its vectors in order of their number: one that lies within the limit (cosine distance to the baseline of all) moves it by alpha. As the limit is
    judged against the fixed mean, the fold is a sum with weights (1 - alpha) ** (how many follow), so no order has to be walked."""
    drift = baselines.vector_drift(vectors).select("vec_id", "cosine")
    x = vectors.join(drift, "vec_id").where(F.col("cosine") <= limit)
    after = F.count("*").over(W.partitionBy("label").orderBy(F.desc("vec_id")).rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("w", alpha * F.pow(F.lit(1 - alpha), after))
    dims = x.select("label", "w", F.posexplode("embedding").alias("i", "e"))
    m = dims.groupBy("label", "i").agg(F.sum(F.col("w") * F.col("e").cast("double")).alias("m"))
    return m.groupBy("label").agg(F.count("*").alias("dimensions"), F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 4).alias("norm"))


def moving_baseline(vectors: DataFrame, alpha: float = 0.05, limit: float = 0.35, metric: str = "l2", overrides: Mapping[int, float] | None = None) -> DataFrame:
    """(label, vec_id, distance, drifting): each vector against its label's baseline as it stands before it. The first vector is the first baseline; one within the limit (or the label's override) moves it by
    alpha, rounded to six digits, one beyond it does not. Whether a vector counts hangs on those before it, so a label is a stream in order that holds one vector."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, base = None, np.zeros(0)
        for b in batches:
            distances, drifts = [], []
            for k, e in zip(b.column("label").to_pylist(), b.column("e").to_pylist(), strict=True):
                v = np.array(e, float)
                if label is None or k != label:
                    label, base = k, v
                    distances.append(0.0)
                    drifts.append(False)
                    continue
                if metric == "l2":
                    d = float(np.sqrt(((base - v) ** 2).sum()))
                else:
                    size = float(np.sqrt((base @ base) * (v @ v)))
                    d = 1 - max(-1.0, min(1.0, float(base @ v) / size)) if size else 1.0
                distances.append(d)
                drifts.append(d > (overrides or {}).get(k, limit))
                if not drifts[-1]:
                    base = np.round((1 - alpha) * base + alpha * v, 6)
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("vec_id"), pa.array(distances, pa.float64()), pa.array(drifts, pa.bool_())], ["label", "vec_id", "distance", "drifting"])

    x = vectors.where("label is not null and embedding is not null").select(F.col("label").cast("long").alias("label"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    return x.repartition("label").sortWithinPartitions("label", "vec_id").mapInArrow(stream, "label long, vec_id long, distance double, drifting boolean")


OPERATORS = {
    "eq": lambda c, v: c == F.lit(v), "neq": lambda c, v: c != F.lit(v), "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v), "contains": lambda c, v: c.contains(v), "starts_with": lambda c, v: c.startswith(v), "exists": lambda c, v: c.isNotNull(), "not_exists": lambda c, v: c.isNull(),
}
MOST_RULES, MOST_CONDITIONS = 1000, 50


def typed_policy(rules: list[Mapping], fields: Mapping[str, Column]) -> tuple[Column, Column]:
    """The first rule by priority whose conditions (field, operator, value) all hold, and its decision; AUDIT where none does. Unknown fields and operators are errors, as are too many rules."""
    if len(rules) > MOST_RULES or any(len(r["conditions"]) > MOST_CONDITIONS for r in rules):
        raise ValueError("too many rules or conditions")
    name, decision = F.lit(None).cast("string"), F.lit("AUDIT")
    for r in sorted(rules, key=lambda r: r["priority"], reverse=True):
        holds = F.lit(True)
        for field, op, value in r["conditions"]:
            if field not in fields or op not in OPERATORS:
                raise ValueError(f"unknown field or operator: {field} {op}")
            holds = holds & F.coalesce(OPERATORS[op](fields[field], value), F.lit(False))
        name, decision = F.when(holds, r["name"]).otherwise(name), F.when(holds, r["decision"]).otherwise(decision)
    return name, decision


RULES = [
    {"name": "night_admin", "priority": 1, "decision": "DENY", "conditions": [("identity.role", "starts_with", "Admin"), ("time.hour_utc", "lt", 6)]},
    {"name": "big_errors", "priority": 2, "decision": "SUSPEND", "conditions": [("event.type", "eq", "error"), ("drift.score", "gte", 0.5), ("identity.region", "not_in", ["r0"])]},
    {"name": "tor", "priority": 3, "decision": "CHALLENGE", "conditions": [("event.network", "contains", "tor"), ("identity.id", "exists", None)]},
    {"name": "bulk", "priority": 4, "decision": "LIMIT", "conditions": [("event.action", "in", ["signup", "purchase"]), ("drift.score", "gt", 0.25), ("drift.score", "lte", 0.4), ("event.resource_id", "neq", "res-5")]},
]


def typed_decisions(ev: DataFrame) -> DataFrame:
    """Typed policies over placed events; a value's 300th part stands for its drift."""
    fields = {
        "identity.id": F.col("actor"), "identity.role": F.col("role"), "identity.region": F.col("region"), "event.type": F.col("action"), "event.action": F.col("action"), "event.resource_id": F.col("resource"), "event.network": F.col("asn"),
        "drift.score": F.col("value") / 300, "time.hour_utc": F.hour("ts"), "time.day_of_week": F.weekday("ts"),
    }
    name, decision = typed_policy(RULES, fields)
    return ev.select("event_id", name.alias("rule"), decision.alias("decision"))


def governed(ev: DataFrame, up: float = 0.25, down: float = 0.2, runs: int = 2) -> DataFrame:
    """Automation scopes (actions) by the precision of their days (share of values over 80): as many days in a row below or above a limit at the end move the scope down or up a state."""
    d = ev.groupBy("action", F.floor(F.col("us") / (3 * DAY)).alias("day")).agg((F.count(F.when(F.col("value") > 80, 1)) / F.count("*")).alias("p"))
    back = W.partitionBy("action").orderBy(F.desc("day"))
    d = d.withColumn("r", F.row_number().over(back))
    first = lambda holds: F.coalesce(F.min(F.when(~holds, F.col("r"))) - 1, F.count("*"))
    a = d.groupBy("action").agg(first(F.col("p") < down).alias("below"), first(F.col("p") > up).alias("above"), F.count("*").alias("n"))
    change = F.when(F.col("below") >= runs, "downgrade").when(F.col("above") >= runs, "upgrade").otherwise("stay")
    return a.select("action", "n", F.col("below").cast("bigint").alias("below"), F.col("above").cast("bigint").alias("above"), change.alias("change"))


def witnesses(ev: DataFrame, n: int = 5) -> DataFrame:
    """What n witnesses report of a ledger by day (the fifth lags, the fourth forks now and then): how many differ from the majority, whether there is a quorum, and each day's forks."""
    d = ev.groupBy(F.floor(F.col("us") / DAY).alias("day")).agg(F.count("*").alias("m"))
    d = d.withColumn("size", F.sum("m").over(W.orderBy("day")))  # a row a day
    x = d.withColumn("witness", F.explode(F.sequence(F.lit(1), F.lit(n))))
    lag = F.when((F.col("witness") == 5) & (F.col("day") % 3 == 0), 1).otherwise(0)
    fork = F.when((F.col("witness") == 4) & (F.col("day") % 4 == 1), "x").otherwise("")
    x = x.select("day", "witness", (F.col("size") - lag * F.col("m")).alias("size"), F.concat((F.col("size") - lag * F.col("m")).cast("string"), fork).alias("root"))
    votes = x.groupBy("day", "root").agg(F.count("*").alias("votes"), F.max("size").alias("size"))
    best = votes.groupBy("day").agg(F.max(F.struct("votes", "root")).alias("b"), F.count("*").alias("roots"))
    forks = votes.groupBy("day", "size").agg(F.count("*").alias("k")).groupBy("day").agg(F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).alias("forks"))
    faulty = (n - 1) // 3
    return best.join(forks, "day").select("day", F.col("b.votes").alias("votes"), (F.lit(n) - F.col("b.votes")).alias("dissent"), (F.col("b.votes") >= 2 * faulty + 1).alias("quorum"), "forks")


def node_features(ev: DataFrame) -> DataFrame:
    """Each actor's feature vector as counts: eight times of day, five actions, three kinds of resource, two risks, padded with zeros to 24."""
    slots = [F.count(F.when(F.floor(F.hour("ts") / 3) == i, 1)) for i in range(8)]
    acts = [F.count(F.when(F.col("action") == a, 1)) for a in ("view", "click", "purchase", "signup", "error")]
    kinds = [F.count(F.when(F.col("k") % 3 == i, 1)) for i in range(3)]
    risks = [F.count(F.when(F.col("k") % 10 == 0, 1)), F.count(F.when(F.col("value") > 100, 1))]
    cells = [*slots, *acts, *kinds, *risks]
    return ev.groupBy("actor").agg(F.array_join(F.concat(F.array(*cells), F.array(*[F.lit(0).cast("bigint")] * (24 - len(cells)))).cast("array<string>"), ",").alias("features"))


def series_cycles(ev: DataFrame, least: float = 0.5) -> DataFrame:
    """Lags (1 to half of a series' length, 24 at most) at which a daily series agrees with itself, and how predictable it is from lags 1 to 4 and its variance."""
    d = series.daily(ev)
    d = d.withColumn("n", F.count("*").over(W.partitionBy("action"))).withColumn("r", F.row_number().over(W.partitionBy("action").orderBy("day")))
    ask = d.withColumn("lag", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(24), F.floor(F.col("n") / 2)).cast("int")))))  # a value a day, 24 lags
    old = d.select("action", F.col("r").alias("r0"), F.col("x").alias("x0"))
    c = ask.withColumn("r0", F.col("r") - F.col("lag")).join(old, ["action", "r0"]).groupBy("action", "lag").agg(F.corr("x", "x0").alias("c"))
    v = d.groupBy("action").agg(F.var_pop("x").alias("v"))
    a = c.groupBy("action").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.abs("c") > least, F.col("lag")))).cast("array<string>"), ",").alias("cycles"), F.avg(F.when(F.col("lag") <= 4, F.abs("c"))).alias("m"))
    return a.join(v, "action").select("action", "cycles", F.round((F.col("m") + 1 / (1 + F.col("v"))) / 2, 6).alias("predictability"))


# Stores


def kept(df: DataFrame, name: str, kind: str = "parquet", parts: list[str] | None = None, mode: str = "append", folder: str | None = None) -> str:
    """Writes or appends df to a folder of the shared store, and returns the folder."""
    folder = folder or f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    w = df.write.mode(mode).format(kind)
    (w.partitionBy(*parts) if parts else w).save(folder)
    return folder


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a JSON-lines log in two batches and read back: counts by action."""
    ev = events(spark, sf_dir).select("event_id", "actor", "action", "resource")
    folder = kept(ev.where("event_id % 2 = 0"), "log", "json")
    kept(ev.where("event_id % 2 = 1"), "log", "json", folder=folder)
    return spark.read.schema(ev.schema).json(folder).groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("d"))


def stored_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines kept by bucket with the digest of each, some damaged after writing; what reading them back finds corrupt."""
    b = baselines.baseline(events(spark, sf_dir), 4).withColumn("body", F.to_json(F.struct("actor", "feature", "n")))
    folder = kept(b.select("actor", "feature", "body", F.sha2("body", 256).alias("digest"), (F.col("actor") % 4).alias("bucket")), "baselines", parts=["bucket"])
    back = spark.read.parquet(folder).withColumn("body", F.when(F.col("actor") % 13 == 5, F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    return back.where(F.sha2("body", 256) != F.col("digest")).select("actor", "feature")


def exported_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit log exported as JSON lines and read back, its digest by actor."""
    ev = events(spark, sf_dir)
    folder = kept(ev.select("event_id", "actor", "action"), "audit", "json")
    back = spark.read.schema("event_id long, actor long, action string").json(folder)
    return back.groupBy("actor").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def _e(f, *a):
    return lambda s, d: f(events(s, d), *a)


def _p(f, *a):
    return lambda s, d: f(cut(placed(events(s, d))), *a)


def _vectors(s, d):
    return adapted(s.read.parquet(f"{d}/embeddings.parquet"))


QUERIES = {
    "r2_exposure": _p(exposure), "r5_composite": _p(composite), "r5_report": _p(risk_report), "r16_metrics": _e(risk_metrics), "r10_signals": _e(aggregated_signals), "bl11_distance": _e(feature_distance), "bl10_stale": _e(stale_baselines), "bl8_soft_limits": _e(soft_limits), "bl7_adapted": _vectors, "bl7_moving": lambda s, d: moving_baseline(read(s, d, "embeddings"), limit=1.38, overrides={1: 1.45, 2: 1.3}).select("label", "vec_id", F.round("distance", 4).alias("distance"), "drifting"),
    "q3_typed": _p(typed_decisions), "q7_governed": _e(governed), "l17_witnesses": _e(witnesses), "m21_features": _e(node_features), "m20_cycles": _e(series_cycles), "s3_appended": appended, "s12_baselines": stored_baselines, "s19_exported": exported_audit,
}
_HEAD = PLACED.replace("WITH ev", "WITH RECURSIVE ev") + escalation._WAYS
_EXPO = """, ne AS (SELECT actor, min(hops) + 1 AS hops FROM asm WHERE hops IS NOT NULL GROUP BY actor), ex AS (SELECT actor, coalesce(any_value(hops), 4) AS hops, max((k % 5 = 0)::INT)::BIGINT AS sensitive FROM pl LEFT JOIN ne USING (actor) GROUP BY actor),
 eo AS (SELECT *, round(0.5 * CASE WHEN hops <= 1 THEN 100 WHEN hops = 2 THEN 75 WHEN hops = 3 THEN 50 ELSE 25 END + 0.3 * least(60, (4 - least(hops, 4)) * 15.0) + 6.0 * sensitive, 4)::DOUBLE AS exposure FROM ex)"""
_COMP = _HEAD + _EXPO + baselines._RISK.replace(EV, "") + """, gr AS (SELECT actor, round(0.6 * least(50, 12 * ln(1 + count(DISTINCT resource))), 4) AS graph FROM ev GROUP BY actor), co AS (SELECT actor, identity, exposure, velocity, graph, round(0.35 * identity + 0.3 * exposure + 0.2 * velocity + 0.15 * graph, 6) AS score, round(0.35 * identity, 6) AS p1, round(0.3 * exposure, 6) AS p2, round(0.2 * velocity, 6) AS p3, round(0.15 * graph, 6) AS p4
 FROM rs JOIN eo USING (actor) JOIN gr USING (actor)), cs AS (SELECT actor, identity, exposure, velocity, graph, score, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 35 THEN 'medium' WHEN score >= 15 THEN 'low' ELSE 'minimal' END AS tier, CASE greatest(p1, p2, p3, p4) WHEN p3 THEN 'velocity' WHEN p1 THEN 'identity' WHEN p4 THEN 'graph' ELSE 'exposure' END AS dominant FROM co)"""
_DAILY = EV + f", d AS (SELECT action, us // {DAY} AS day, avg(value) AS x FROM ev GROUP BY ALL)"
_LIMIT = "CASE o.label WHEN 1 THEN 1.45 WHEN 2 THEN 1.3 ELSE 1.38 END"
ORACLE = {
    "bl7_moving": f"""WITH RECURSIVE o AS (SELECT label::BIGINT AS label, vec_id::BIGINT AS vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
 w AS (SELECT label, vec_id, r, e AS base, 0.0::DOUBLE AS distance, false AS drifting FROM o WHERE r = 1
  UNION ALL SELECT o.label, o.vec_id, o.r, CASE WHEN list_distance(w.base, o.e) > {_LIMIT} THEN w.base ELSE list_transform(list_zip(w.base, o.e), lambda x: round(0.95 * x[1] + 0.05 * x[2], 6)) END, list_distance(w.base, o.e), list_distance(w.base, o.e) > {_LIMIT} FROM w JOIN o ON o.label = w.label AND o.r = w.r + 1)
 SELECT label, vec_id, round(distance, 4) AS distance, drifting FROM w""",
    "r2_exposure": _HEAD + _EXPO + " SELECT actor, hops, sensitive, exposure FROM eo",
    "r5_composite": _COMP + " SELECT * FROM cs",
    "r5_report": _COMP + " SELECT tier, count(*) AS n, round(avg(score), 4) AS mean, min(score) AS least, max(score) AS most FROM cs GROUP BY tier",
    "r16_metrics": baselines._RISK + ", p AS (SELECT avg(score) AS mean, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.8) AS p80, quantile_cont(score, 0.95) AS p95 FROM rs) SELECT round(mean, 5) AS mean, round(median, 5) AS median, round(p80, 5) AS p80, round(p95, 5) AS p95, (SELECT count(*) FROM rs WHERE score > p.p80) AS n_high FROM p",
    "r10_signals": EV + ", x AS (SELECT actor, least(value / 200, 1.0) AS s, CASE action WHEN 'error' THEN 0.9 WHEN 'purchase' THEN 0.7 WHEN 'signup' THEN 0.5 END::DOUBLE AS c FROM ev) SELECT actor, count(*) AS n, round(least(1.0, sum(s * c) / sum(c)), 6) AS score FROM x WHERE c IS NOT NULL GROUP BY actor",
    "bl11_distance": baselines._LONG + """, md AS (SELECT actor, (min(us) + max(us)) / 2 AS mid FROM ev GROUP BY actor), m AS (SELECT actor, feature, avg(x) FILTER (us <= mid) AS m0, avg(x) FILTER (us > mid) AS m1, count(*) FILTER (us <= mid) AS n FROM lf JOIN md USING (actor) GROUP BY ALL)
 SELECT actor, CASE WHEN bool_or(m0 IS NULL OR m1 IS NULL) THEN -1.0 ELSE round(sqrt(sum(pow(m1 - m0, 2))), 5) END::DOUBLE AS distance, substr(sha256(string_agg(feature || '=' || n, ';' ORDER BY feature)), 1, 16) AS digest FROM m GROUP BY actor""",
    "bl10_stale": EV + f", x AS (SELECT resource, max(us) AS last_us, (SELECT max(us) FROM ev) - max(us) AS age FROM ev GROUP BY resource) SELECT resource, last_us, CASE WHEN age > {24 * HOUR} THEN 'expired' ELSE 'stale' END AS status FROM x WHERE age > {8 * HOUR}",
    "bl8_soft_limits": _DAILY.replace("WITH ev", "WITH RECURSIVE ev") + """, o AS (SELECT action, x, row_number() OVER (PARTITION BY action ORDER BY day) AS r FROM d), f AS (SELECT action, 0::BIGINT AS r, x * 1.5 AS a, x * 1.5 AS s FROM o WHERE r = 1 UNION ALL SELECT f.action, f.r + 1, f.a + 0.05 * greatest(o.x - f.a, 0), s FROM f JOIN o ON o.action = f.action AND o.r = f.r + 1)
 SELECT action, round(any_value(s), 5) AS first, round(max_by(a, r), 5) AS last, (SELECT count(*) FROM o WHERE o.action = f.action AND o.x > any_value(f.s)) AS breaches FROM f GROUP BY action""",
    "q3_typed": PLACED + """ SELECT event_id, CASE WHEN starts_with(role, 'Admin') AND hour(ts) < 6 THEN 'night_admin' WHEN action = 'error' AND value / 300 >= 0.5 AND region <> 'r0' THEN 'big_errors' WHEN contains(asn, 'tor') THEN 'tor' WHEN action IN ('signup', 'purchase') AND value / 300 > 0.25 AND value / 300 <= 0.4 AND resource <> 'res-5' THEN 'bulk' END AS rule,
 CASE WHEN starts_with(role, 'Admin') AND hour(ts) < 6 THEN 'DENY' WHEN action = 'error' AND value / 300 >= 0.5 AND region <> 'r0' THEN 'SUSPEND' WHEN contains(asn, 'tor') THEN 'CHALLENGE' WHEN action IN ('signup', 'purchase') AND value / 300 > 0.25 AND value / 300 <= 0.4 AND resource <> 'res-5' THEN 'LIMIT' ELSE 'AUDIT' END AS decision FROM pl""",
    "q7_governed": EV + f""", d AS (SELECT action, us // {3 * DAY} AS day, count(*) FILTER (value > 80) / count(*) AS p FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY day DESC) AS r FROM d), a AS (SELECT action, count(*) AS n, coalesce(min(r) FILTER (NOT p < 0.2) - 1, count(*)) AS below, coalesce(min(r) FILTER (NOT p > 0.25) - 1, count(*)) AS above FROM r GROUP BY action)
 SELECT action, n, below, above, CASE WHEN below >= 2 THEN 'downgrade' WHEN above >= 2 THEN 'upgrade' ELSE 'stay' END AS change FROM a""",
    "l17_witnesses": EV + f""", d AS (SELECT us // {DAY} AS day, count(*) AS m FROM ev GROUP BY 1), s AS (SELECT day, m, CAST(sum(m) OVER (ORDER BY day) AS BIGINT) AS z FROM d), w AS (SELECT day, w, z - CASE WHEN w = 5 AND day % 3 = 0 THEN m ELSE 0 END AS size, CASE WHEN w = 4 AND day % 4 = 1 THEN 'x' ELSE '' END AS fk FROM s, range(1, 6) t(w)),
 v AS (SELECT day, size || fk AS root, count(*) AS votes, max(size) AS size FROM w GROUP BY 1, 2), b AS (SELECT day, max(votes) AS votes FROM v GROUP BY day), f AS (SELECT day, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS forks FROM (SELECT day, size, count(*) AS k FROM v GROUP BY 1, 2) GROUP BY day) SELECT day, votes, 5 - votes AS dissent, votes >= 3 AS quorum, forks FROM b JOIN f USING (day)""",
    "m21_features": EV + " SELECT actor, array_to_string([" + ", ".join([f"count(*) FILTER (hour(ts) // 3 = {i})" for i in range(8)] + [f"count(*) FILTER (action = '{a}')" for a in ("view", "click", "purchase", "signup", "error")] + [f"count(*) FILTER (k % 3 = {i})" for i in range(3)] + ["count(*) FILTER (k % 10 = 0)", "count(*) FILTER (value > 100)"] + ["0"] * 6) + "], ',') AS features FROM ev GROUP BY actor",
    "m20_cycles": _DAILY + """, o AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY day) AS r, count(*) OVER (PARTITION BY action) AS n FROM d), c AS (SELECT a.action, a.r - b.r AS lag, corr(a.x, b.x) AS c FROM o a JOIN o b ON a.action = b.action AND a.r - b.r BETWEEN 1 AND least(24, a.n // 2) GROUP BY ALL)
 SELECT action, coalesce(string_agg(lag::VARCHAR, ',' ORDER BY lag) FILTER (abs(c) > 0.5), '') AS cycles, round((avg(abs(c)) FILTER (lag <= 4) + 1 / (1 + any_value(v))) / 2, 6) AS predictability FROM c JOIN (SELECT action, var_pop(x) AS v FROM d GROUP BY action) USING (action) GROUP BY action""",
    "s3_appended": EV + " SELECT action, count(*) AS n, count(DISTINCT event_id) AS d FROM ev GROUP BY action",
    "s12_baselines": baselines._LONG + " SELECT DISTINCT actor, feature FROM lf WHERE actor % 13 = 5",
    "s19_exported": EV + " SELECT actor, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM ev GROUP BY actor",
}
