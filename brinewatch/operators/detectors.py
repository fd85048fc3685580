"""Detectors over placed events: each gives alerts (detector, subtype, actor, subject, event_id, severity); they are unioned, then gated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from brinewatch.functions import periods
from brinewatch.functions.predicates import char_entropy
from brinewatch.operators import escalation, windows as win
from brinewatch.operators.escalation import alerts, joined
from brinewatch.operators.intake import first_in_period
from brinewatch.operators.windows import PLACED, in_order, placed, sliding_distinct, trailing
from brinewatch.sources.tables import DAY, cut, events


SECOND = 1_000_000
#: Windows and thresholds for the test events, which are minutes apart; the defaults are those for live ones.
SPARSE = {
    "lateral_movement": {"us": 3 * DAY, "crowd": 3, "many": 2, "hops": 2}, "token_abuse": {"ips_us": DAY, "uses_us": DAY, "tokens_us": DAY, "ips": 3, "uses": 4, "tokens": 2}, "rate_spikes": {"us": DAY, "least": 4},
    "identity_anomalies": {"z": 1.2, "busy": 2, "kinds": 5}, "movement_velocity": {"us": 2 * DAY, "least": 4}, "composite_anomaly": {"us": DAY, "least": 4},
}


def lateral_movement(ev: DataFrame, us: int = 300 * SECOND, crowd: int = 5, many: int = 4, hops: int = 3) -> DataFrame:
    """Crowded roles, fast role changes, account hops, service accounts in other roles, and new regions. Purchases stand for assumed roles; every seventh actor is a service account."""
    roles = ev.where("action = 'purchase'").select("event_id", "actor", "us", "role", "account", "region")
    x = cut(sliding_distinct(sliding_distinct(sliding_distinct(roles, "role", "actor", us, "crowd"), "actor", "role", us, "many"), "actor", "account", us, "hops"))  # three rules read it
    first = roles.withColumn("_r", F.row_number().over(W.partitionBy("actor", "region").orderBy("us", "event_id"))).withColumn("_n", F.row_number().over(in_order()))
    return joined(
        alerts(x.where(F.col("crowd") > crowd), "lateral", "role_overcrowding", "medium", "role"), alerts(x.where(F.col("many") > many), "lateral", "role_velocity", "high", "role"),
        alerts(x.where(F.col("hops") > hops), "lateral", "cross_account_hop", "high", "role"), alerts(roles.where("actor % 7 = 0 and role not like 'svc-%'"), "lateral", "service_account_pivot", "high", "role"),
        alerts(first.where("_r = 1 and _n > 1"), "lateral", "new_region_activity", "medium", "role"),
    )


def token_abuse(ev: DataFrame, ips_us: int = 120 * SECOND, uses_us: int = 60 * SECOND, tokens_us: int = 60 * SECOND, ips: int = 3, uses: int = 30, tokens: int = 10, kmh: float = 900.0) -> DataFrame:
    """Tokens from many addresses, impossibly far away, after revocation (an error of value over 100), from suspicious networks, used often, from outside their network; many tokens from one address."""
    rows = ev.select("event_id", "actor", "us", "action", "value", "token", "ip", "lat", "lon", "asn").withColumn("_u", F.lit(1))
    x = cut(periods.neighbours(periods.cut_up(rows, 2 * max(ips_us, tokens_us)), ["token", "ip"], ["us"]))  # read for both counts
    y = win.come_and_gone(x.select("event_id", "actor", "us", "token", "ip", "_u", "_before", "_after", "_p"), "ip", "token", tokens_us, "_t")
    y = periods.running_sum(periods.cut_up(y, 2 * tokens_us), ["ip"], "_t", "tokens").where("_u = 1")
    # one stream of a token's uses, of addresses and uses that leave their windows, and of what earlier periods carry
    revokes, here = F.when((F.col("action") == "error") & (F.col("value") > 100), F.col("us")), F.struct("us", "event_id", "lat", "lon")
    gone = x.select("token", (F.col("us") + uses_us + 1).alias("us"), F.lit(-1).alias("_u"))
    z = win.come_and_gone(x, "token", "ip", ips_us, "_i").withColumns({"_v": F.when(F.col("_u") == 1, revokes), "_row": F.when(F.col("_u") == 1, here)})
    z = periods.cut_up(z.unionByName(gone, allowMissingColumns=True), 2 * max(ips_us, uses_us))
    z = periods.led(periods.led(z, ["token"], {"_i": F.sum, "_u": F.sum, "_v": F.min}).withColumnRenamed("_added", "_led"), ["token"], {"_row": F.max})
    z = z.withColumns({"_before": F.max("_row").over(periods.before(["token"])), "revoked": F.min("_v").over(periods.before(["token"]))})
    z = z.withColumns({"ips": F.sum("_i").over(periods.so_far(["token"])), "uses": F.sum("_u").over(periods.so_far(["token"]))}).where("_added is null and _led is null and _u = 1")
    km = win.haversine(F.col("_before.lat"), F.col("_before.lon"), F.col("lat"), F.col("lon"))
    hours = F.greatest((F.col("us") - F.col("_before.us")) / float(win.HOUR), F.lit(1e-6))
    network = F.concat(F.lit("10."), (F.col("actor") % 4).cast("string"), F.lit(".0.0"))
    outside = ~escalation.in_cidr(F.col("ip"), network, F.lit(16))
    return joined(
        escalation.all_alerts(z, "token", "token", [
            (F.col("ips") > ips, "multi_ip_usage", "high"), (F.round(km / hours, 3) > kmh, "impossible_travel", "high"), (F.col("us") > F.col("revoked"), "revoked_token_reuse", "critical"),
            (F.col("asn").like("%tor%"), "suspicious_network_origin", "medium"), (F.col("uses") > uses, "high_frequency", "medium"), (outside, "out_of_cidr", "high"),
        ]),
        alerts(y.where(F.col("tokens") > tokens), "token", "credential_stuffing", "critical", "token"),
    )


def dormant_identity(ev: DataFrame) -> DataFrame:
    """Returns after silence, odd hours, a first privileged action, acts of disabled identities (a signup of value over 150 disables), and more kinds of resource than before."""
    ev = ev.select("event_id", "actor", "us", "ts", "action", "resource", "value")
    back = win.dormancy(ev)
    odd = win.hour_zscores(ev)
    first = ev.where("action = 'purchase'").withColumn("_r", F.row_number().over(in_order())).where("_r = 1")
    disabled = F.min(F.when((F.col("action") == "signup") & (F.col("value") > 150), F.col("us"))).over(in_order().rowsBetween(W.unboundedPreceding, -1))
    after = ev.withColumn("disabled", disabled).where("us > disabled")
    w = W.partitionBy("actor").orderBy("us")
    scope = sliding_distinct(ev, "actor", "resource", 2 * DAY, "now").withColumn("old", F.size(F.collect_set("resource").over(w.rangeBetween(-9 * DAY, -2 * DAY - 1)))).where("old >= 1 and now > 2 * old")
    none = F.lit("")
    return joined(
        alerts(back, "dormant", "dormancy_reactivation", F.col("severity"), none), alerts(odd, "dormant", "off_hours_activity", "medium", none), alerts(first, "dormant", "first_high_priv_action", "high", none),
        alerts(after, "dormant", "disabled_identity_active", "critical", none), alerts(scope, "dormant", "scope_explosion", "high", none),
    )


def rate_spikes(ev: DataFrame, us: int = 60 * SECOND, least: int = 20) -> DataFrame:
    """1 for events of actors with at least so many events in the window, else 0."""
    return ev.select("event_id", "actor", F.when(F.count("*").over(trailing(us)) >= least, 1.0).otherwise(0.0).alias("score"))


def scored(ev: DataFrame, us: int = 60 * SECOND, least: int = 20) -> DataFrame:
    """Weighted signals of each event: rarity .20, sensitive .15, high risk .25, new subnet .15, entropy of the agent .10, rate .15; with the event's time."""
    n = F.count("*").over(trailing(us))
    all_before, same = (F.count("*").over(W.partitionBy(*k).orderBy("us", "event_id").rowsBetween(W.unboundedPreceding, -1)) for k in (["actor"], ["actor", "action"]))
    first = F.row_number().over(W.partitionBy("actor", "subnet").orderBy("us", "event_id"))
    x = ev.select("event_id", "actor", "us", "k", "action", "subnet", "agent").withColumns({"_n": all_before, "_m": same, "_rate": F.when(n >= least, 1.0).otherwise(0.0), "_first": first})
    rarity = F.round(F.when(F.col("_m") == 0, 1.0).otherwise(1 - F.pow(F.col("_m") / F.col("_n"), 0.3)), 6)
    subnet = F.when((F.col("_first") == 1) & (F.col("_n") > 0), 0.8).otherwise(0.0)
    sensitive, risky = F.when(F.col("k") % 10 == 0, 0.4).otherwise(0.0), F.when(F.col("action").isin("purchase", "error"), 0.5).otherwise(0.0)
    entropy = F.when(F.col("agent") == "", 9.0).otherwise(F.round(char_entropy(F.col("agent")), 9))
    scripted = F.when(entropy < 2.5, 0.6).when((entropy < 3.5) | (F.col("agent") == ""), 0.3).otherwise(0.0)  # few kinds of characters, or none
    score = 0.20 * rarity + 0.15 * sensitive + 0.25 * risky + 0.15 * subnet + 0.10 * scripted + 0.15 * F.col("_rate")
    return x.select("event_id", "actor", "us", F.round(score, 6).alias("score"))


def composite_anomaly(ev: DataFrame, us: int = 60 * SECOND, least: int = 20) -> DataFrame:
    """The score of each event."""
    return scored(ev, us, least).drop("us")


def identity_anomalies(ev: DataFrame, z: float = 3.0, busy: int = 200, resources: int = 30, kinds: int = 16) -> DataFrame:
    """Busy hours, many resources, many actions, privileged shares, and distance from the role's peers (moments of each peer group, joined back: no group is one window)."""
    peak = ev.groupBy("actor", F.date_trunc("hour", "ts")).agg(F.count("*").alias("n")).groupBy("actor").agg(F.max("n").alias("peak"))
    a = ev.groupBy("actor").agg(F.count("*").alias("n"), F.countDistinct("resource").alias("resources"), F.countDistinct("action").alias("actions"), F.count(F.when(F.col("action") == "purchase", 1)).alias("privileged")).join(peak, "actor")
    a = a.withColumn("peer", F.col("actor") % 5)
    peers = a.groupBy("peer").agg(F.count("*").alias("peers"), F.avg("n").alias("m"), F.stddev_pop("n").alias("s"))  # five rows
    a = a.join(F.broadcast(peers), "peer").withColumn("z", F.when(F.col("s") == 0, 0.0).otherwise((F.col("n") - F.col("m")) / F.col("s")))
    flags = F.array_compact(F.array(F.when(F.col("peak") > busy, F.lit("velocity_spike")), F.when(F.col("resources") > resources, F.lit("unusual_resource")), F.when(F.col("actions") >= kinds, F.lit("action_diversity")), F.when(F.col("privileged") > 0, F.lit("privileged")), F.when((F.col("peers") >= 3) & (F.abs("z") > z), F.lit("peer_deviation"))))
    return a.select("actor", "n", "resources", "actions", "privileged", "peak", F.round("z", 6).alias("z"), F.array_join(flags, ",").alias("flags"))


def movement_velocity(ev: DataFrame, us: int = 600 * SECOND, least: int = 6) -> DataFrame:
    """Moments at which an actor has touched many different resources within the window."""
    return win.distinct_in_window(ev, "resource", us).where(F.col("n_distinct") >= least)


def engine(ev: DataFrame) -> DataFrame:
    """All five detectors; high becomes critical where the event's anomaly is large; repeats of a detector, actor and subject within a day go."""
    ev = cut(ev)
    ways = escalation.ways_up(ev)
    found = joined(lateral_movement(ev, **SPARSE["lateral_movement"]), token_abuse(ev, **SPARSE["token_abuse"]), dormant_identity(ev), escalation.privilege_escalation(ev, ways), escalation.privilege_chain(ev, ways))
    x = found.where("actor is not null and subject is not null").join(scored(ev, **SPARSE["composite_anomaly"]).select("event_id", "us", "score"), "event_id")
    x = x.withColumn("severity", F.when((F.col("severity") == "high") & (F.col("score") > 0.5), "critical").otherwise(F.col("severity")))
    kept = first_in_period(x, ["actor", "detector", "subject"], DAY, ["subtype", "severity"])
    return kept.groupBy("detector", "subtype", "severity").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def copy_gate(ev: DataFrame) -> DataFrame:
    """Actors whose path of resources passes all four gates: hops, a privilege step, observations, contexts."""
    step = F.col("k") % 10 - F.lag(F.col("k") % 10).over(in_order())
    a = ev.select("actor", "region", "us", "event_id", step.alias("step")).groupBy("actor").agg((F.count("*") - 1).alias("hops"), F.max("step").alias("step"), F.countDistinct("region").alias("contexts"))
    return a.where("hops >= 2 and step >= 1 and contexts >= 2")


def _p(f):
    return lambda s, d: f(placed(events(s, d)), **SPARSE.get(f.__name__, {}))


QUERIES = {
    "a2_lateral_movement": _p(lateral_movement), "a3_token_abuse": _p(token_abuse), "a4_dormant_identity": _p(dormant_identity), "a6_composite_anomaly": _p(composite_anomaly), "w14_rate_spikes": _p(rate_spikes),
    "a7_engine": _p(engine), "a8_copy_gate": _p(copy_gate), "a10_movement_velocity": _p(movement_velocity), "a13_identity_anomalies": _p(identity_anomalies),
}


def _range(keys: str, us: int, what: str) -> str:
    return f"{what} OVER (PARTITION BY {keys} ORDER BY us RANGE BETWEEN {us} PRECEDING AND CURRENT ROW)"


def _rows(name: str, detector: str, found: list[tuple[str, str, str, str]]) -> str:
    """Alerts from (subtype, severity, subject, FROM and WHERE)."""
    return f", {name} AS (" + " UNION ALL ".join(f"SELECT '{detector}' AS detector, '{t}' AS subtype, actor, CAST({x} AS VARCHAR) AS subject, event_id, {v if v.startswith('CASE') else repr(v)} AS severity FROM {f}" for t, v, x, f in found) + ")"


_ORD = "OVER (PARTITION BY actor ORDER BY us, event_id"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LATERAL = f""", lx AS (SELECT *, {_range('role', 3 * DAY, 'count(DISTINCT actor)')} AS crowd, {_range('actor', 3 * DAY, 'count(DISTINCT role)')} AS many, {_range('actor', 3 * DAY, 'count(DISTINCT account)')} AS hops, row_number() OVER (PARTITION BY actor, region ORDER BY us, event_id) AS r, row_number() {_ORD}) AS n FROM pl WHERE action = 'purchase')""" + _rows("lateral_rows", "lateral", [
    ("role_overcrowding", "medium", "role", "lx WHERE crowd > 3"), ("role_velocity", "high", "role", "lx WHERE many > 2"), ("cross_account_hop", "high", "role", "lx WHERE hops > 2"),
    ("service_account_pivot", "high", "role", "lx WHERE actor % 7 = 0 AND NOT starts_with(role, 'svc-')"), ("new_region_activity", "medium", "role", "lx WHERE r = 1 AND n > 1"),
])
_TORD = "OVER (PARTITION BY token ORDER BY us, event_id"
_TOKEN = f""", tp AS (SELECT *, lag(lat) {_TORD}) AS la, lag(lon) {_TORD}) AS lo, lag(us) {_TORD}) AS lu, min(us) FILTER (action = 'error' AND value > 100) {_TORD} {_BEFORE} AS revoked, {_range('token', DAY, 'count(DISTINCT ip)')} AS ips, {_range('token', DAY, 'count(*)')} AS uses, {_range('ip', DAY, 'count(DISTINCT token)')} AS tokens FROM pl),
 tx AS (SELECT *, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)))) / greatest((us - lu) / {win.HOUR}.0, 1e-6), 3) AS kmh FROM tp)""" + _rows("token_rows", "token", [
    ("multi_ip_usage", "high", "token", "tx WHERE ips > 3"), ("impossible_travel", "high", "token", "tx WHERE kmh > 900"), ("revoked_token_reuse", "critical", "token", "tx WHERE us > revoked"), ("suspicious_network_origin", "medium", "token", "tx WHERE contains(asn, 'tor')"),
    ("high_frequency", "medium", "token", "tx WHERE uses > 4"), ("out_of_cidr", "high", "token", "tx WHERE k % 4 <> actor % 4"), ("credential_stuffing", "critical", "token", "tx WHERE tokens > 2"),
])
_DORMANT = f""", hx AS (SELECT *, CAST(hour(ts) AS DOUBLE) AS h, us - lag(us) {_ORD}) AS gap, min(us) FILTER (action = 'signup' AND value > 150) {_ORD} {_BEFORE} AS disabled FROM pl), hy AS (SELECT *, count(h) {_ORD} {_BEFORE} AS n, avg(h) {_ORD} {_BEFORE} AS m, stddev_pop(h) {_ORD} {_BEFORE} AS s FROM hx),
 sx AS (SELECT *, {_range('actor', 2 * DAY, 'count(DISTINCT resource)')} AS now, count(DISTINCT resource) OVER (PARTITION BY actor ORDER BY us RANGE BETWEEN {9 * DAY} PRECEDING AND {2 * DAY + 1} PRECEDING) AS old FROM pl)""" + _rows("dormant_rows", "dormant", [
    ("dormancy_reactivation", f"CASE WHEN gap > {5 * DAY} THEN 'critical' ELSE 'high' END", "''", f"hx WHERE gap >= {3 * DAY}"), ("off_hours_activity", "medium", "''", "hy WHERE n >= 20 AND round(CASE WHEN s < 1e-9 THEN 0 ELSE abs(h - m) / s END, 6) > 1.5"),
    ("first_high_priv_action", "high", "''", f"(SELECT *, row_number() {_ORD}) AS r FROM pl WHERE action = 'purchase') WHERE r = 1"), ("disabled_identity_active", "critical", "''", "hx WHERE us > disabled"), ("scope_explosion", "high", "''", "sx WHERE old >= 1 AND now > 2 * old"),
])
_SCORE = f""", cx AS (SELECT *, CASE WHEN {_range('actor', DAY, 'count(*)')} >= 4 THEN 1.0 ELSE 0.0 END AS rate, row_number() OVER (PARTITION BY actor, subnet ORDER BY us, event_id) AS f, row_number() {_ORD}) AS a, count(*) {_ORD} {_BEFORE} AS n,
 count(*) OVER (PARTITION BY actor, action ORDER BY us, event_id {_BEFORE} AS m, list_sum(list_transform(list_distinct(string_split(agent, '')), lambda c: -(len(list_filter(string_split(agent, ''), lambda x: x = c)) / len(string_split(agent, ''))) * log2(len(list_filter(string_split(agent, ''), lambda x: x = c)) / len(string_split(agent, ''))))) AS bits FROM pl), score_rows AS (SELECT event_id, actor, us, round(0.20 * round(CASE WHEN m = 0 THEN 1.0 ELSE 1 - pow(m * 1.0 / n, 0.3) END, 6)
 + 0.15 * CASE WHEN k % 10 = 0 THEN 0.4 ELSE 0 END + 0.25 * CASE WHEN action IN ('purchase', 'error') THEN 0.5 ELSE 0 END + 0.10 * CASE WHEN agent = '' THEN 0.3 WHEN bits < 2.5 THEN 0.6 WHEN bits < 3.5 THEN 0.3 ELSE 0 END + 0.15 * CASE WHEN f = 1 AND a > 1 THEN 0.8 ELSE 0 END + 0.15 * rate, 6)::DOUBLE AS score FROM cx)"""
ORACLE = {
    "a2_lateral_movement": PLACED + _LATERAL + " SELECT * FROM lateral_rows",
    "a3_token_abuse": PLACED + _TOKEN + " SELECT * FROM token_rows",
    "a4_dormant_identity": PLACED + _DORMANT + " SELECT * FROM dormant_rows",
    "a6_composite_anomaly": PLACED + _SCORE + " SELECT event_id, actor, score FROM score_rows",
    "w14_rate_spikes": PLACED + f" SELECT event_id, actor, CASE WHEN {_range('actor', DAY, 'count(*)')} >= 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM pl",
    "a7_engine": PLACED.replace("WITH ev", "WITH RECURSIVE ev") + _LATERAL + _TOKEN + _DORMANT + escalation.ESCALATION_SQL + escalation.CHAIN_SQL + _SCORE + f""", al AS (SELECT a.*, s.us, CASE WHEN severity = 'high' AND score > 0.5 THEN 'critical' ELSE severity END AS sev FROM (SELECT * FROM lateral_rows UNION ALL SELECT * FROM token_rows UNION ALL SELECT * FROM dormant_rows UNION ALL SELECT * FROM escalation_rows UNION ALL SELECT * FROM chain_rows) a JOIN score_rows s USING (event_id)),
 o AS (SELECT *, row_number() OVER (PARTITION BY actor, detector, subject ORDER BY us, event_id) AS rn FROM (SELECT DISTINCT actor, detector, subject, us, event_id FROM al)),
 r AS (SELECT actor, detector, subject, event_id, rn, us AS last, true AS keep FROM o WHERE rn = 1 UNION ALL SELECT o.actor, o.detector, o.subject, o.event_id, o.rn, CASE WHEN o.us - r.last > {DAY} THEN o.us ELSE r.last END, o.us - r.last > {DAY} FROM r JOIN o ON o.actor = r.actor AND o.detector = r.detector AND o.subject = r.subject AND o.rn = r.rn + 1)
 SELECT detector, subtype, sev AS severity, count(*) AS n, min(event_id) AS first_event FROM al SEMI JOIN (SELECT * FROM r WHERE keep) q USING (actor, detector, subject, event_id) GROUP BY 1, 2, 3""",
    "a8_copy_gate": PLACED + f""", s AS (SELECT actor, region, k % 10 - lag(k % 10) {_ORD}) AS step FROM pl) SELECT * FROM (SELECT actor, count(*) - 1 AS hops, max(step) AS step, count(DISTINCT region) AS contexts FROM s GROUP BY actor) WHERE hops >= 2 AND step >= 1 AND contexts >= 2""",
    "a10_movement_velocity": PLACED + f" SELECT * FROM (SELECT event_id, actor, {_range('actor', 2 * DAY, 'count(DISTINCT resource)')} AS n_distinct FROM pl) WHERE n_distinct >= 4",
    "a13_identity_anomalies": PLACED + """, pk AS (SELECT actor, max(n) AS peak FROM (SELECT actor, date_trunc('hour', ts), count(*) AS n FROM pl GROUP BY ALL) GROUP BY actor), a AS (SELECT actor, count(*) AS n, count(DISTINCT resource) AS resources, count(DISTINCT action) AS actions, count(*) FILTER (action = 'purchase') AS privileged FROM pl GROUP BY actor),
 z AS (SELECT a.*, peak, count(*) OVER (PARTITION BY actor % 5) AS peers, CASE WHEN stddev_pop(n) OVER (PARTITION BY actor % 5) = 0 THEN 0 ELSE (n - avg(n) OVER (PARTITION BY actor % 5)) / stddev_pop(n) OVER (PARTITION BY actor % 5) END AS z FROM a JOIN pk USING (actor))
 SELECT actor, n, resources, actions, privileged, peak, round(z, 6) AS z, concat_ws(',', CASE WHEN peak > 2 THEN 'velocity_spike' END, CASE WHEN resources > 30 THEN 'unusual_resource' END, CASE WHEN actions >= 5 THEN 'action_diversity' END, CASE WHEN privileged > 0 THEN 'privileged' END, CASE WHEN peers >= 3 AND abs(z) > 1.2 THEN 'peer_deviation' END) AS flags FROM z""",
}
