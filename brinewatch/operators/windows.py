"""Windows, sessions, velocity and entropy over events (actor, us, action, resource, value, event_id).

Every window is keyed by actor, so it is one shuffle on the actor; frames over microseconds stay inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from brinewatch.functions import periods
from brinewatch.sources.tables import DAY, EV, HOUR, cut, events

def in_order() -> W:
    return W.partitionBy("actor").orderBy("us", "event_id")


def trailing(us: int) -> W:
    return W.partitionBy("actor").orderBy("us").rangeBetween(-us, 0)


def velocity(ev: DataFrame, us: int = DAY) -> DataFrame:
    """Events of the actor in the trailing window, and a burst score of at most 1."""
    n = F.count("*").over(trailing(us))
    return ev.select("event_id", "actor", n.alias("n_window"), F.round(F.least(n / F.lit(10.0), F.lit(1.0)), 6).alias("burst"))


def sliding_distinct(ev: DataFrame, key: str, what: str, us: int, name: str) -> DataFrame:
    """ev with the number of distinct values of what in the key's trailing window, as name (null values don't count).

    A value comes (+1) where it wasn't in the window before, and goes (-1) when the window ends after its last sight; the running sum of
    these is the count. So a row costs two rows of a running sum, however many values the window holds; sums run within periods of eight
    windows, so a key's history is many tasks.
    """
    x = cut(periods.neighbours(periods.cut_up(ev, 8 * us), [key, what], ["us"]))  # read four times
    both = come_and_gone(x, key, what, us, "_d")
    return periods.running_sum(periods.cut_up(both, 8 * us), [key], "_d", name).where("event_id is not null").drop("_d", "_p")


def come_and_gone(x: DataFrame, key: str, what: str, us: int, d: str) -> DataFrame:
    """x (with what's neighbours) with 1 as d where a value comes into the key's trailing window, else 0, and rows without event_id and with -1 for values that go."""
    there = F.col(what).isNotNull()
    rows = x.withColumn(d, F.when(there & (F.col("_before").isNull() | (F.col("us") - F.col("_before.us") > us)), 1).otherwise(0))
    gone = x.where(there & (F.col("_after").isNull() | (F.col("_after.us") - F.col("us") > us))).select(key, (F.col("us") + us + 1).alias("us"), F.lit(-1).alias(d))
    return rows.drop("_before", "_after", "_p").unionByName(gone, allowMissingColumns=True)


def distinct_in_window(ev: DataFrame, what: str = "resource", us: int = 3 * DAY) -> DataFrame:
    """Distinct values in the trailing window."""
    return sliding_distinct(ev.select("event_id", "actor", "us", what), "actor", what, us, "n_distinct").select("event_id", "actor", "n_distinct")


def hour_peaks(ev: DataFrame) -> DataFrame:
    """The busiest hour's count, the number of hours, and the mean per hour of each actor."""
    hours = ev.groupBy("actor", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    return hours.groupBy("actor").agg(F.max("n").alias("peak"), F.count("*").alias("n_hours"), F.round(F.avg("n"), 6).alias("mean_per_hour"))


def sessions(ev: DataFrame, gap: int = 12 * HOUR) -> DataFrame:
    """Each event's session: a gap of more than gap begins a new one."""
    new = F.when(F.col("us") - F.lag("us").over(in_order()) > gap, 1).otherwise(0)
    return ev.withColumn("_new", new).select("event_id", "actor", "us", F.sum("_new").over(in_order()).cast("bigint").alias("session"))


def session_means(ev: DataFrame, gap: int = 12 * HOUR) -> DataFrame:
    """Sessions of an actor, and the mean length in seconds of those with two events or more."""
    each = sessions(ev, gap).groupBy("actor", "session").agg(F.count("*").alias("n"), ((F.max("us") - F.min("us")) / 1e6).alias("sec"))
    return each.groupBy("actor").agg(F.count("*").alias("n_sessions"), F.round(F.avg(F.when(F.col("n") >= 2, F.col("sec"))), 6).alias("mean_seconds"))


def anchored_velocity(ev: DataFrame, us: int = 2 * DAY) -> DataFrame:
    """Events of each actor in the window before its last event."""
    last = F.max("us").over(W.partitionBy("actor"))
    return ev.withColumn("_last", last).where(F.col("us") >= F.col("_last") - us).groupBy("actor").agg(F.count("*").alias("n_recent"))


def entropy(ev: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Shannon entropy in bits of what within keys."""
    n = ev.groupBy(*keys, what).agg(F.count("*").alias("n"))
    h = n.groupBy(*keys).agg(F.sum("n").alias("n_events"), F.count("*").alias("n_values"), F.sum(F.col("n") * F.log2("n")).alias("_s"))
    return h.select(*keys, "n_events", "n_values", F.round(F.abs(F.log2("n_events") - F.col("_s") / F.col("n_events")), 6).alias("entropy"))


def top_actions(ev: DataFrame, k: int = 5) -> DataFrame:
    """The k commonest resources of each actor (ties: the smaller name)."""
    n = ev.groupBy("actor", "resource").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("actor").orderBy(F.desc("n"), "resource")).cast("bigint")).where(F.col("place") <= k)


def entropy_spikes(ev: DataFrame, what: str = "action", short: int = 2 * DAY, long: int = 20 * DAY, least: float = 1.5, ratio: float = 0.8) -> DataFrame:
    """Actors whose entropy of one variable in the last short window is large, in itself and against that of the last long window."""
    ends = ev.withColumn("_last", F.max("us").over(W.partitionBy("actor")))
    within = lambda us, name: entropy(ends.where(F.col("us") >= F.col("_last") - us), ["actor"], what).select("actor", F.col("entropy").alias(name))
    recent, whole = within(short, "h_short"), within(long, "h_long")
    return recent.join(whole, "actor").where((F.col("h_short") > least) & (F.col("h_long") > 0) & (F.col("h_short") / F.col("h_long") >= ratio))


def conditional_entropy(ev: DataFrame) -> DataFrame:
    """Entropy of an actor's action given the one before."""
    pairs = ev.withColumn("before", F.lag("action").over(in_order())).where("before is not null")
    n = pairs.groupBy("actor", "before", "action").agg(F.count("*").alias("n"))
    n = n.withColumn("m", F.sum("n").over(W.partitionBy("actor", "before"))).withColumn("t", F.sum("n").over(W.partitionBy("actor")))
    return n.groupBy("actor").agg(F.round(F.abs(F.sum(-F.col("n") / F.col("t") * F.log2(F.col("n") / F.col("m")))), 6).alias("h_cond"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def impossible_travel(ev: DataFrame, kmh: float = 900.0) -> DataFrame:
    """Events farther from the actor's previous one than speed allows; ev has lat and lon."""
    w = in_order()
    km = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    hours = F.greatest((F.col("us") - F.lag("us").over(w)) / float(HOUR), F.lit(1e-6))
    return ev.select("event_id", "actor", F.round(km, 3).alias("km"), F.round(km / hours, 3).alias("speed")).where(F.col("speed") > kmh)


def hour_zscores(ev: DataFrame, least: int = 20, limit: float = 1.5) -> DataFrame:
    """Events at an hour far from the actor's earlier ones (population deviation; earlier events only)."""
    w = in_order().rowsBetween(W.unboundedPreceding, -1)
    x = ev.withColumn("h", F.hour("ts").cast("double"))
    x = x.select("event_id", "actor", "h", F.count("h").over(w).alias("n"), F.avg("h").over(w).alias("m"), F.stddev_pop("h").over(w).alias("s"))
    z = F.when(F.col("s") < 1e-9, 0.0).otherwise(F.abs(F.col("h") - F.col("m")) / F.col("s"))
    return x.where(F.col("n") >= least).withColumn("z", F.round(z, 6)).where(F.col("z") > limit).select("event_id", "actor", "n", "z")


def dormancy(ev: DataFrame, gap: int = 3 * DAY, critical: int = 5 * DAY) -> DataFrame:
    """Returns after a long silence."""
    d = F.col("us") - F.lag("us").over(in_order())
    return ev.withColumn("gap_us", d).where(F.col("gap_us") >= gap).select("event_id", "actor", "gap_us", F.when(F.col("gap_us") > critical, "critical").otherwise("high").alias("severity"))


def rarity(ev: DataFrame) -> DataFrame:
    """1 for an action that the actor never did before, else 1 - share ** 0.3, from counts before the event."""
    all_before = F.count("*").over(in_order().rowsBetween(W.unboundedPreceding, -1))
    same = F.count("*").over(W.partitionBy("actor", "action").orderBy("us", "event_id").rowsBetween(W.unboundedPreceding, -1))
    return ev.withColumn("_n", all_before).withColumn("_m", same).select("event_id", "actor", F.round(F.when(F.col("_m") == 0, 1.0).otherwise(1 - F.pow(F.col("_m") / F.col("_n"), 0.3)), 6).alias("rarity"))


def new_subnets(ev: DataFrame) -> DataFrame:
    """0.8 for the first event from a subnet after the actor's first one; ev has subnet."""
    first = F.row_number().over(W.partitionBy("actor", "subnet").orderBy("us", "event_id"))
    x = ev.withColumn("_first", first).withColumn("_at", F.row_number().over(in_order()))
    return x.select("event_id", "actor", "subnet", F.when((F.col("_first") == 1) & (F.col("_at") > 1), 0.8).otherwise(0.0).alias("score"))


def latency(ev: DataFrame) -> DataFrame:
    """Exact percentiles of value by action, with throughput per hour."""
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    a = ev.groupBy("action").agg(F.count("*").alias("n"), p.alias("p"), ((F.max("us") - F.min("us")) / float(HOUR)).alias("h"))
    return a.select("action", "n", *(F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p50", "p95", "p99"))), F.round(F.col("n") / F.col("h"), 6).alias("per_hour"))


def summary(ev: DataFrame) -> DataFrame:
    return ev.groupBy("action").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


#: User agents for test events: none, a script's, a library's, a browser's.
AGENTS = ("", "curl", "python-requests", "Mozilla/5.0 (X11; Linux x86_64)")


def placed(ev: DataFrame) -> DataFrame:
    """Events with a made-up place, subnet, region, account, token, role, network and agent, for detectors that need them."""
    e = F.col("event_id")
    return (
        ev.withColumn("lat", ((e * 37) % 121 - 60).cast("double")).withColumn("lon", ((e * 73) % 301 - 150).cast("double"))
        .withColumn("subnet", F.concat(F.lit("10."), (F.col("k") % 4).cast("string"), F.lit("."), (e % 3).cast("string")))
        .withColumn("ip", F.concat("subnet", F.lit("."), (e % 5).cast("string"))).withColumn("region", F.concat(F.lit("r"), (F.col("k") % 3).cast("string")))
        .withColumn("account", F.concat(F.lit("acc"), (F.col("k") % 7).cast("string"))).withColumn("token", F.concat(F.lit("tok"), (F.col("actor") % 11).cast("string")))
        .withColumn("role", F.concat(F.when(F.col("k") % 10 == 0, "AdminRole-").when(F.col("k") % 4 == 1, "svc-role-").otherwise("role-"), F.col("k").cast("string")))
        .withColumn("agent", F.element_at(F.array(*map(F.lit, AGENTS)), (e % 4 + 1).cast("int"))).withColumn("asn", F.when(e % 29 == 0, "AS-tor-exit").otherwise(F.concat(F.lit("AS"), (F.col("k") % 50).cast("string"))))
    )


PLACED = EV + """, pl AS (SELECT *, CAST((event_id * 37) % 121 - 60 AS DOUBLE) AS lat, CAST((event_id * 73) % 301 - 150 AS DOUBLE) AS lon, '10.' || (k % 4) || '.' || (event_id % 3) AS subnet,
 '10.' || (k % 4) || '.' || (event_id % 3) || '.' || (event_id % 5) AS ip, 'r' || (k % 3) AS region, 'acc' || (k % 7) AS account, 'tok' || (actor % 11) AS token,
 CASE WHEN k % 10 = 0 THEN 'AdminRole-' WHEN k % 4 = 1 THEN 'svc-role-' ELSE 'role-' END || k AS role, CASE WHEN event_id % 29 = 0 THEN 'AS-tor-exit' ELSE 'AS' || (k % 50) END AS asn, [""" + ", ".join(f"'{a}'" for a in AGENTS) + "][event_id % 4 + 1] AS agent FROM ev)"


def _q(f, with_place: bool = False, **kw):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ev = events(spark, sf_dir)
        return f(placed(ev) if with_place else ev, **kw)

    return query


QUERIES = {
    "w1_velocity": _q(velocity),
    "w3_distinct_in_window": _q(distinct_in_window),
    "w4_hour_peaks": _q(hour_peaks),
    "w5_sessions": lambda s, d: sessions(events(s, d)).select("event_id", "actor", "session"),
    "w6_session_means": _q(session_means),
    "w7_anchored_velocity": _q(anchored_velocity),
    "w8_entropy": lambda s, d: entropy(events(s, d), ["actor"], "action"),
    "w8_top_resources": _q(top_actions),
    "w9_entropy_spikes": _q(entropy_spikes),
    "w10_conditional_entropy": _q(conditional_entropy),
    "w11_impossible_travel": _q(impossible_travel, with_place=True),
    "w12_hour_zscores": _q(hour_zscores),
    "w13_dormancy": _q(dormancy),
    "w15_rarity": _q(rarity),
    "w16_new_subnets": _q(new_subnets, with_place=True),
    "w17_latency": _q(latency),
    "w18_summary": _q(summary),
}

ORD = "OVER (PARTITION BY actor ORDER BY us, event_id"
ORACLE = {
    "w1_velocity": EV + f" SELECT event_id, actor, n AS n_window, round(least(n / 10.0, 1.0), 6)::DOUBLE AS burst FROM (SELECT *, count(*) OVER (PARTITION BY actor ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS n FROM ev)",
    "w3_distinct_in_window": EV + f" SELECT event_id, actor, count(DISTINCT resource) OVER (PARTITION BY actor ORDER BY us RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW) AS n_distinct FROM ev",
    "w4_hour_peaks": EV + " SELECT actor, max(n) AS peak, count(*) AS n_hours, round(avg(n), 6) AS mean_per_hour FROM (SELECT actor, date_trunc('hour', ts), count(*) AS n FROM ev GROUP BY ALL) GROUP BY actor",
    "w5_sessions": EV + f" SELECT event_id, actor, CAST(sum(new) {ORD}) AS BIGINT) AS session FROM (SELECT *, CASE WHEN us - lag(us) {ORD}) > {12 * HOUR} THEN 1 ELSE 0 END AS new FROM ev)",
    "w6_session_means": EV + f""", s AS (SELECT actor, us, sum(new) {ORD}) AS session FROM (SELECT *, CASE WHEN us - lag(us) {ORD}) > {12 * HOUR} THEN 1 ELSE 0 END AS new FROM ev))
 SELECT actor, count(*) AS n_sessions, round(avg(CASE WHEN n >= 2 THEN sec END), 6) AS mean_seconds FROM (SELECT actor, session, count(*) AS n, (max(us) - min(us)) / 1e6 AS sec FROM s GROUP BY ALL) GROUP BY actor""",
    "w7_anchored_velocity": EV + f" SELECT actor, count(*) AS n_recent FROM (SELECT *, max(us) OVER (PARTITION BY actor) AS last FROM ev) WHERE us >= last - {2 * DAY} GROUP BY actor",
    "w8_entropy": EV + " SELECT actor, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_values, round(abs(-sum(p * log2(p))), 6) AS entropy FROM (SELECT actor, action, count(*) AS n, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY actor) AS p FROM ev GROUP BY actor, action) GROUP BY actor",
    "w8_top_resources": EV + " SELECT * FROM (SELECT actor, resource, count(*) AS n, row_number() OVER (PARTITION BY actor ORDER BY count(*) DESC, resource) AS place FROM ev GROUP BY actor, resource) WHERE place <= 5",
    "w9_entropy_spikes": EV + ", en AS (SELECT *, max(us) OVER (PARTITION BY actor) AS last FROM ev), " + ", ".join(f"{n} AS (SELECT actor, round(abs(-sum(p * log2(p))), 6) AS h_{n} FROM (SELECT actor, action, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY actor) AS p FROM en WHERE us >= last - {us} GROUP BY actor, action) GROUP BY actor)" for n, us in (("short", 2 * DAY), ("long", 20 * DAY)))
    + " SELECT actor, h_short, h_long FROM short JOIN long USING (actor) WHERE h_short > 1.5 AND h_long > 0 AND h_short / h_long >= 0.8",
    "w10_conditional_entropy": EV + f""", p AS (SELECT actor, action, lag(action) {ORD}) AS before FROM ev), n AS (SELECT actor, before, action, count(*) AS n FROM p WHERE before IS NOT NULL GROUP BY ALL),
 m AS (SELECT *, sum(n) OVER (PARTITION BY actor, before) AS m, sum(n) OVER (PARTITION BY actor) AS t FROM n) SELECT actor, round(abs(sum(-(n / t) * log2(n / m))), 6) AS h_cond FROM m GROUP BY actor""",
    "w11_impossible_travel": PLACED + f""", p AS (SELECT *, lag(lat) {ORD}) AS la, lag(lon) {ORD}) AS lo, lag(us) {ORD}) AS lu FROM pl),
 d AS (SELECT *, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)))) AS d FROM p)
 SELECT event_id, actor, round(d, 3) AS km, round(d / greatest((us - lu) / {HOUR}.0, 1e-6), 3) AS speed FROM d WHERE round(d / greatest((us - lu) / {HOUR}.0, 1e-6), 3) > 900""",
    "w12_hour_zscores": EV + f""", x AS (SELECT *, CAST(hour(ts) AS DOUBLE) AS h FROM ev), y AS (SELECT *, count(h) {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n, avg(h) {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m,
 stddev_pop(h) {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM x), z AS (SELECT event_id, actor, n, round(CASE WHEN s < 1e-9 THEN 0 ELSE abs(h - m) / s END, 6) AS z FROM y WHERE n >= 20) SELECT * FROM z WHERE z > 1.5""",
    "w13_dormancy": EV + f" SELECT event_id, actor, gap_us, CASE WHEN gap_us > {5 * DAY} THEN 'critical' ELSE 'high' END AS severity FROM (SELECT *, us - lag(us) {ORD}) AS gap_us FROM ev) WHERE gap_us >= {3 * DAY}",
    "w15_rarity": EV + f""" SELECT event_id, actor, round(CASE WHEN m = 0 THEN 1.0 ELSE 1 - pow(m * 1.0 / n, 0.3) END, 6) AS rarity FROM (SELECT *, count(*) {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n,
 count(*) OVER (PARTITION BY actor, action ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev)""",
    "w16_new_subnets": PLACED + f" SELECT event_id, actor, subnet, CASE WHEN f = 1 AND a > 1 THEN 0.8 ELSE 0.0 END::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY actor, subnet ORDER BY us, event_id) AS f, row_number() {ORD}) AS a FROM pl)",
    "w17_latency": EV + f" SELECT action, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(count(*) / ((max(us) - min(us)) / {HOUR}.0), 6) AS per_hour FROM ev GROUP BY action",
    "w18_summary": EV + " SELECT action, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, count(*) AS n FROM ev GROUP BY action",
}
