"""Beliefs and time series: Bayes in odds, trends, smoothing, forecasts, cycles. Series are daily means by action, short arrays per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from brinewatch.sources.tables import DAY, EV, events


def daily(ev: DataFrame) -> DataFrame:
    """(action, day number, x): the mean value of each day."""
    return ev.groupBy("action", F.floor(F.col("us") / DAY).alias("day")).agg(F.avg("value").alias("x"))


def beliefs(ev: DataFrame) -> DataFrame:
    """Belief of each actor from prior .1 after each event's likelihood, as odds: the product is a sum of logarithms."""
    lik = F.when(F.col("action") == "error", 0.8).when(F.col("action") == "purchase", 0.6).otherwise(0.45)
    odds = F.log(F.lit(0.1 / 0.9)) + F.sum(F.log(lik / 0.5))
    a = ev.groupBy("actor").agg(odds.alias("o"), F.count("*").alias("n"))
    return a.select("actor", F.round(1 / (1 + F.exp(-F.col("o"))), 6).alias("belief"), F.round(0.3 / F.sqrt("n"), 6).alias("sigma"))


def confidence(ev: DataFrame) -> DataFrame:
    """min(n / 10, 1) times the share of the majority among an actor's last five outcomes."""
    w = W.partitionBy("actor").orderBy(F.desc("us"), F.desc("event_id"))
    x = ev.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy("actor"))).where("r <= 5")
    up = F.count(F.when(F.col("value") > 10, 1))
    return x.groupBy("actor").agg(F.round(F.least(F.first("n") / 10.0, F.lit(1.0)) * F.greatest(up, F.count("*") - up) / F.count("*"), 6).alias("confidence"))


def conjugate(ev: DataFrame) -> DataFrame:
    """Beta posterior of an error from Beta(2, 5), and the Normal posterior mean of value from N(10, 25) with noise variance 100."""
    n, e = F.count("*"), F.count(F.when(F.col("action") == "error", 1))
    precision = 1 / 25.0 + n / 100.0
    return ev.groupBy("actor").agg((e + 2).alias("alpha"), (n - e + 5).alias("beta"), F.round((e + 2) / (n + 7), 6).alias("p_error"), F.round((10 / 25.0 + F.sum("value") / 100.0) / precision, 6).alias("mean"))


def likelihood_grid(ev: DataFrame) -> DataFrame:
    """Binary Bayes of each action's error share over ten likelihoods."""
    p = ev.groupBy("actor").agg((F.count(F.when(F.col("action") == "error", 1)) / F.count("*")).alias("p"))
    g = p.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn("lik", F.col("i") / 10.0)
    return g.select("actor", F.col("i").cast("bigint").alias("i"), F.round(F.col("p") * F.col("lik") / (F.col("p") * F.col("lik") + (1 - F.col("p")) * (1 - F.col("lik"))), 6).alias("posterior"))


def trends(ev: DataFrame) -> DataFrame:
    """Slope, intercept and fit of each action's daily means, and a forecast three days on with its band."""
    d = daily(ev)
    a = d.groupBy("action").agg(F.regr_slope("x", "day").alias("b"), F.regr_intercept("x", "day").alias("a"), F.regr_r2("x", "day").alias("r2"), F.regr_syy("x", "day").alias("syy"), F.count("*").alias("n"), F.max("day").alias("last"))
    band = 1.96 * F.sqrt(F.col("syy") * (1 - F.col("r2")) / F.col("n"))
    x = a.withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("f", F.col("a") + F.col("b") * (F.col("last") + F.col("ahead")))
    kind = F.when(F.abs("b") < 0.1, "stable").when(F.col("b") > 0, "rising").otherwise("falling")
    return x.select("action", F.col("ahead").cast("bigint").alias("ahead"), F.round("b", 5).alias("slope"), F.round("r2", 5).alias("r2"), kind.alias("trend"), F.round("f", 4).alias("forecast"), F.round(band, 4).alias("band"))


def seasonality(ev: DataFrame) -> DataFrame:
    """Lag-1 to lag-3 autocorrelation of the daily means."""
    w = W.partitionBy("action").orderBy("day")
    d = daily(ev)
    cols = [F.corr("x", f"l{k}").alias(f"c{k}") for k in (1, 2, 3)]
    a = d.select("action", "x", *(F.lag("x", k).over(w).alias(f"l{k}") for k in (1, 2, 3))).groupBy("action").agg(*cols)
    return a.select("action", *(F.round(f"c{k}", 5).alias(f"c{k}") for k in (1, 2, 3)), (F.col("c1") > 0.3).alias("seasonal"))


def anomalies(ev: DataFrame) -> DataFrame:
    """min(1, |z| / 3) of each daily mean among its action's (five days at least)."""
    w = W.partitionBy("action")
    z = F.abs(F.col("x") - F.avg("x").over(w)) / F.stddev_pop("x").over(w)
    return daily(ev).withColumn("n", F.count("*").over(w)).withColumn("score", F.round(F.least(F.lit(1.0), z / 3), 5)).where("n >= 5").select("action", "day", "score")


def smoothed(ev: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Exponential smoothing of each action's daily means, folded in order; an AR(1) value two days on."""
    s = daily(ev).groupBy("action").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "x"))), lambda e: e["x"]).alias("v"))  # a value a day
    fold = F.aggregate(F.slice("v", F.lit(2), F.size("v")), F.col("v")[0], lambda a, x: alpha * x + (1 - alpha) * a)
    return s.select("action", F.round(fold, 5).alias("level"), F.round(F.element_at("v", -1) * 0.7**2, 5).alias("ar2"))


def acceleration(ev: DataFrame) -> DataFrame:
    """Second differences of the daily means: the mean of the last five."""
    w = W.partitionBy("action").orderBy("day")
    x = daily(ev).withColumn("d2", F.lead("x").over(w) - 2 * F.col("x") + F.lag("x").over(w)).where("d2 is not null").withColumn("r", F.row_number().over(W.partitionBy("action").orderBy(F.desc("day"))))
    return x.where("r <= 5").groupBy("action").agg(F.round(F.avg("d2"), 5).alias("acceleration"), (F.avg("d2") > 0.2).alias("accelerating"))


def rolling(ev: DataFrame) -> DataFrame:
    """Centred three-day means and the moves between them."""
    w = W.partitionBy("action").orderBy("day")
    m = daily(ev).withColumn("m", F.avg("x").over(w.rowsBetween(-1, 1)))
    return m.select("action", "day", F.round("m", 5).alias("mean"), F.round(F.col("m") - F.lag("m").over(w), 5).alias("move"))


def forecast(ev: DataFrame, hours: int = 24, decay: float = 0.99, band: float = 0.2) -> DataFrame:
    """(actor, step, risk, low, high): each actor's risk in the hours after its last event, by trend and hour of day.

    The trend is the last centred mean of min(7, n / 2) events' risks (a 300th of the value, 1 at most), falling by 1 % an hour; nine to five adds a tenth, other hours take one off. Under seven events there is none.
    """
    last = W.partitionBy("actor").orderBy(F.desc("us"), F.desc("event_id"))
    x = ev.select("actor", "us", "ts", F.least(F.col("value") / 300, F.lit(1.0)).alias("risk"), F.row_number().over(last).alias("r"), F.count("*").over(W.partitionBy("actor")).alias("n"))
    x = x.where((F.col("n") >= 7) & (F.col("r") <= F.least(F.lit(7), F.expr("n div 2"))))
    a = x.groupBy("actor").agg(F.avg("risk").alias("trend"), F.hour(F.max("ts")).alias("hour"))
    a = a.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(hours))))
    busy = F.when(((F.col("hour") + F.col("step")) % 24).between(9, 17), 1.1).otherwise(0.9)
    risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("trend") * F.pow(F.lit(decay), F.col("step")) * busy))
    return a.withColumn("risk", risk).select("actor", "step", *(F.round(c, 6).alias(n) for n, c in (("risk", F.col("risk")), ("low", F.greatest(F.lit(0.0), F.col("risk") - band)), ("high", F.least(F.lit(1.0), F.col("risk") + band)))))


def _e(f):
    return lambda s, d: f(events(s, d))


QUERIES = {
    "m1_beliefs": _e(beliefs), "m2_confidence": _e(confidence), "m8_conjugate": _e(conjugate), "m24_likelihood_grid": _e(likelihood_grid), "m12_trends": _e(trends), "m13_seasonality": _e(seasonality), "m14_anomalies": _e(anomalies),
    "m15_smoothed": _e(smoothed), "m19_acceleration": _e(acceleration), "m18_rolling": _e(rolling), "m18_forecast": _e(forecast),
}

_D = EV + f", dd AS (SELECT action, us // {DAY} AS day, avg(value) AS x FROM ev GROUP BY ALL)"
ORACLE = {
    "m1_beliefs": EV + ", o AS (SELECT actor, ln(0.1 / 0.9) + sum(ln(CASE action WHEN 'error' THEN 0.8 WHEN 'purchase' THEN 0.6 ELSE 0.45 END / 0.5)) AS o, count(*) AS n FROM ev GROUP BY actor) SELECT actor, round(1 / (1 + exp(-o)), 6) AS belief, round(0.3 / sqrt(n), 6) AS sigma FROM o",
    "m2_confidence": EV + ", x AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY us DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY actor) AS n FROM ev) SELECT actor, round(least(any_value(n) / 10.0, 1.0) * greatest(count(*) FILTER (value > 10), count(*) FILTER (value <= 10)) / count(*), 6)::DOUBLE AS confidence FROM x WHERE r <= 5 GROUP BY actor",
    "m8_conjugate": EV + ", c AS (SELECT actor, count(*) AS n, count(*) FILTER (action = 'error') AS e, sum(value) AS s FROM ev GROUP BY actor) SELECT actor, e + 2 AS alpha, n - e + 5 AS beta, round((e + 2) / (n + 7.0), 6)::DOUBLE AS p_error, round((10 / 25.0 + s / 100.0) / (1 / 25.0 + n / 100.0), 6)::DOUBLE AS mean FROM c",
    "m24_likelihood_grid": EV + ", p AS (SELECT actor, count(*) FILTER (action = 'error') * 1.0 / count(*) AS p FROM ev GROUP BY actor) SELECT actor, i, round(p * (i / 10.0) / (p * (i / 10.0) + (1 - p) * (1 - i / 10.0)), 6)::DOUBLE AS posterior FROM p, range(1, 10) t(i)",
    "m12_trends": _D + """, a AS (SELECT action, regr_slope(x, day) AS b, regr_intercept(x, day) AS a, regr_r2(x, day) AS r2, regr_syy(x, day) AS syy, count(*) AS n, max(day) AS last FROM dd GROUP BY action)
 SELECT action, ahead, round(b, 5) AS slope, round(r2, 5) AS r2, CASE WHEN abs(b) < 0.1 THEN 'stable' WHEN b > 0 THEN 'rising' ELSE 'falling' END AS trend, round(a + b * (last + ahead), 4) AS forecast, round(1.96 * sqrt(syy * (1 - r2) / n), 4) AS band FROM a, range(1, 4) t(ahead)""",
    "m13_seasonality": _D + ", l AS (SELECT action, x, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2, lag(x, 3) OVER w AS l3 FROM dd WINDOW w AS (PARTITION BY action ORDER BY day)) SELECT action, round(corr(x, l1), 5) AS c1, round(corr(x, l2), 5) AS c2, round(corr(x, l3), 5) AS c3, corr(x, l1) > 0.3 AS seasonal FROM l GROUP BY action",
    "m14_anomalies": _D + ", z AS (SELECT *, count(*) OVER (PARTITION BY action) AS n, abs(x - avg(x) OVER (PARTITION BY action)) / stddev_pop(x) OVER (PARTITION BY action) AS z FROM dd) SELECT action, day, round(least(1.0, z / 3), 5) AS score FROM z WHERE n >= 5",
    "m15_smoothed": _D + ", s AS (SELECT action, list(x ORDER BY day) AS v FROM dd GROUP BY action) SELECT action, round(list_reduce(v, lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a), 5) AS level, round(v[-1] * pow(0.7, 2), 5) AS ar2 FROM s",
    "m19_acceleration": _D + ", d AS (SELECT action, day, lead(x) OVER w - 2 * x + lag(x) OVER w AS d2 FROM dd WINDOW w AS (PARTITION BY action ORDER BY day)), r AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY day DESC) AS r FROM d WHERE d2 IS NOT NULL) SELECT action, round(avg(d2), 5) AS acceleration, avg(d2) > 0.2 AS accelerating FROM r WHERE r <= 5 GROUP BY action",
    "m18_forecast": EV + """, x AS (SELECT actor, ts, least(value / 300, 1.0) AS risk, row_number() OVER (PARTITION BY actor ORDER BY us DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY actor) AS n FROM ev),
 a AS (SELECT actor, avg(risk) AS trend, hour(max(ts)) AS h FROM x WHERE n >= 7 AND r <= least(7, n // 2) GROUP BY actor), f AS (SELECT actor, step::INT AS step, greatest(0.0, least(1.0, trend * pow(0.99, step) * CASE WHEN (h + step) % 24 BETWEEN 9 AND 17 THEN 1.1 ELSE 0.9 END)) AS risk FROM a, range(1, 25) t(step))
 SELECT actor, step, round(risk, 6) AS risk, round(greatest(0.0, risk - 0.2), 6) AS low, round(least(1.0, risk + 0.2), 6) AS high FROM f""",
    "m18_rolling": _D + ", m AS (SELECT action, day, avg(x) OVER (PARTITION BY action ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM dd) SELECT action, day, round(m, 5) AS mean, round(m - lag(m) OVER (PARTITION BY action ORDER BY day), 5) AS move FROM m",
}
