"""Raw events: bytes and envelopes to the canonical schema, its checks, enrichment, guards, invariants, and near duplicates.

Payloads are a binary column. Base64, JSON and envelopes are parsed by Spark's own functions; only gzip, which Spark can't open, goes through a small Arrow function.
"""

from __future__ import annotations

import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf

from brinewatch.functions import predicates as P
from brinewatch.operators.intake import first_in_period
from brinewatch.operators.windows import PLACED, haversine, in_order, placed
from brinewatch.sources.tables import DAY, EV, HOUR, events

# The canonical schema's allowed values and longest texts.
SOURCES = ("aws", "azure", "gcp", "okta", "github", "webhook", "pagerduty", "custom", "internal")
SEVERITIES = ("critical", "high", "medium", "low", "info")
ACTOR_TYPES = ("user", "service_account", "role", "machine", "unknown")
LONGEST = {"actor": 512, "action": 256, "resource": 2048, "resource_type": 256, "service": 128, "region": 64, "account_id": 128, "event_id": 256}
# The canonical event's fields, types and defaults.
TEXTS = {"event_id": "", "source": "", "service": "", "action": "", "actor": "", "actor_type": "unknown", "resource": "", "resource_type": "", "ip": "", "region": "", "account_id": "", "severity": "info"}
MAPS = ("geo", "identity", "threat_intel", "resource_meta", "session", "raw")
LOWERED = ("source", "service", "actor_type", "severity")

PLAIN = "source string, service string, event_id string, action string, actor string, resource string, ip string, region string, timestamp string, severity string, actor_type string"
CLOUD_EVENT = "specversion string, id string, source string, type string, subject string, time string, data struct<action string, resource string>"
TRAIL_RECORD = "eventID string, eventName string, userIdentity struct<arn string, userName string>, requestParameters struct<resource string>, sourceIPAddress string, awsRegion string, eventTime string"
FIELDS = ("source", "service", "event_id", "action", "actor", "resource", "ip", "region", "timestamp", "severity", "actor_type")


def _gunzipped(data: pd.Series) -> pd.Series:
    def opened(b: bytes | None) -> bytes | None:
        if b is None or b[:2] != b"\x1f\x8b":
            return b
        try:
            return zlib.decompress(b, 31)
        except zlib.error:
            return None

    return data.map(opened)


def gunzipped(payload: Column) -> Column:
    """Payloads that begin like gzip, opened; what can't be opened is null, what isn't gzip stays."""
    return pandas_udf(_gunzipped, "binary")(payload)


def _gzipped(data: pd.Series) -> pd.Series:
    def closed(b: bytes) -> bytes:
        c = zlib.compressobj(wbits=31)
        return c.compress(b) + c.flush()

    return data.map(closed)


def gzipped(payload: Column) -> Column:
    return pandas_udf(_gzipped, "binary")(payload)


def utf8(data: Column) -> Column:
    """Bytes as text, null where they aren't UTF-8."""
    return F.try_validate_utf8(data.cast("string"))


def text_of(payload: Column) -> Column:
    """JSON text of a payload: gzip opened, base64 of JSON decoded, else UTF-8; null where there is none."""
    t = utf8(gunzipped(payload))
    inner = utf8(F.try_to_binary(F.trim(t), F.lit("base64")))
    json = lambda c: F.when(F.ltrim(c).rlike(r"^[\[{]"), c)
    return F.coalesce(json(t), json(inner))


def opened(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Canonical fields of raw payloads, with the envelope's name: CloudEvents, trail records (all of them), queue bodies and stream records, which may hold another envelope, or
    plain objects. What is no JSON object goes to no row: see unreadable."""
    t = raw.withColumn("_t", text_of(F.col(column)))
    # a queue body or a stream record holds text of its own: at most two layers are taken off
    for _ in range(2):
        has = lambda name: F.col("_t").contains(name) | F.col("_t").contains("\\u")  # noqa: E731, only such texts are searched for the key (which may be written in escapes)
        body, data = F.when(has("body"), F.get_json_object("_t", "$.body")), F.when(has("kinesis"), F.get_json_object("_t", "$.kinesis.data"))
        inner = F.coalesce(F.when(F.ltrim(body).startswith("{"), body), utf8(F.try_to_binary(data, F.lit("base64"))))
        t = t.withColumn("_t", F.coalesce(inner, F.col("_t")))
    cloud = F.from_json("_t", CLOUD_EVENT)
    records = F.from_json(F.get_json_object("_t", "$.Records"), f"array<struct<{TRAIL_RECORD.replace(' string', ':string').replace(' struct', ':struct')}>>")
    t = t.withColumns({"_c": cloud, "_r": records, "_o": F.from_json("_t", PLAIN)})
    none = F.lit(None).cast("string")

    def event(**given: Column) -> Column:
        return F.struct(*(given.get(f, none).alias(f) for f in FIELDS), given["envelope"].alias("envelope"))

    c = F.col("_c")
    of_cloud = event(source=c["source"], service=c["type"], event_id=c["id"], action=c["data"]["action"], actor=c["subject"], resource=c["data"]["resource"], timestamp=c["time"], envelope=F.lit("cloudevents"))
    of_trail = lambda r: event(source=F.lit("aws"), service=F.lit("cloudtrail"), event_id=r["eventID"], action=r["eventName"], actor=F.coalesce(r["userIdentity"]["arn"], r["userIdentity"]["userName"]), resource=r["requestParameters"]["resource"], ip=r["sourceIPAddress"], region=r["awsRegion"], timestamp=r["eventTime"], envelope=F.lit("cloudtrail"))
    of_plain = event(**{f: F.col(f"_o.{f}") for f in FIELDS}, envelope=F.lit("none"))
    is_cloud = c["specversion"].isNotNull() & c["id"].isNotNull() & c["source"].isNotNull() & c["type"].isNotNull()
    found = F.when(is_cloud, F.array(of_cloud)).when(F.get(F.col("_r"), F.lit(0))["eventName"].isNotNull(), F.transform("_r", of_trail)).otherwise(F.array(of_plain))
    # filters on _t or before explode would be pushed below the projections, and payloads opened and parsed again for each
    return t.select(F.explode_outer(F.when(F.col("_t").isNotNull(), found)).alias("_e")).where("_e is not null").select("_e.*")


def unreadable(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Payloads from which no JSON can be had, for the dead letters."""
    return raw.withColumn("_t", text_of(F.col(column))).where("_t is null or try_parse_json(_t) is null").drop("_t")


def canonical(ev: DataFrame) -> DataFrame:
    """The 23 fields of the canonical schema from whichever of them are there: texts with defaults, some lower-cased, the time as a number."""
    have = set(ev.columns)
    texts = [(F.lower if n in LOWERED else lambda c: c)(F.coalesce(F.col(n).cast("string"), F.lit(d)) if n in have else F.lit(d)).alias(n) for n, d in TEXTS.items()]
    maps = [(F.coalesce(F.col(n), F.create_map().cast("map<string,string>")) if n in have else F.create_map().cast("map<string,string>")).alias(n) for n in MAPS]
    stamp = (F.col("timestamp").try_cast("double") if "timestamp" in have else F.lit(None).cast("double")).alias("timestamp")
    tags = (F.coalesce("tags", F.array().cast("array<string>")) if "tags" in have else F.array().cast("array<string>")).alias("tags")
    return ev.select(*texts, stamp, tags, *maps, F.lit(False).alias("enriched"), F.lit(0.0).alias("enriched_at"), F.lit("2.0").alias("schema_version"))


def schema_failure(ev: DataFrame) -> Column:
    """The first field of an event that breaks the canonical schema, or null."""
    lower = lambda n, d: F.lower(F.coalesce(F.col(n), F.lit(d)))
    checks = {
        "missing_source": F.length(F.coalesce("source", F.lit(""))) > 0, "source": lower("source", "").isin(*SOURCES), "severity": lower("severity", "info").isin(*SEVERITIES),
        "actor_type": lower("actor_type", "unknown").isin(*ACTOR_TYPES), "timestamp": F.col("timestamp").isNull() | F.col("timestamp").try_cast("double").isNotNull(),
    }
    checks |= {n: F.length(F.coalesce(F.col(n), F.lit(""))) <= m for n, m in LONGEST.items() if n in ev.columns}
    return P.first_failure(**checks)


def enriched(ev: DataFrame, identities: DataFrame, threats: DataFrame) -> DataFrame:
    """Events with identity (department, of its actor), known threat of its address, a resource class and a session key. identities and threats have one row a key."""
    kind = F.when(F.col("k") % 10 == 0, "crown_jewel").when(F.col("k") % 3 == 0, "database").otherwise("generic")
    x = ev.join(identities, "actor", "left").join(threats, "ip", "left")
    session = F.substring(F.sha2(F.concat_ws(":", F.col("actor").cast("string"), F.col("ip"), F.floor(F.col("us") / (12 * HOUR)).cast("string")), 256), 1, 16)
    return x.select("event_id", F.coalesce("department", F.lit("unknown")).alias("department"), F.coalesce("threat", F.lit("none")).alias("threat"), kind.alias("resource_class"), session.alias("session"))


def guarded(ev: DataFrame, us: int = 3 * DAY, most: int = 5, fastest: float = 900.0) -> DataFrame:
    """The guard's action on each event: halt on more than so many privileged events of the actor within us (and on what follows while they are), drop on impossible speed, flag on service accounts with interactive events."""
    w = in_order()
    runs = F.count(F.when(F.col("action") == "purchase", 1)).over(W.partitionBy("actor").orderBy("us").rangeBetween(-us, 0))
    km = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    kmh = F.round(km / F.greatest((F.col("us") - F.lag("us").over(w)) / float(HOUR), F.lit(1e-6)), 3)
    rule = F.when(runs > most, "rapid_escalation").when(kmh > fastest, "impossible_geo").when((F.col("actor") % 7 == 0) & (F.col("action") == "click"), "service_interactive")
    act = F.when(F.col("rule") == "rapid_escalation", "halt").when(F.col("rule") == "impossible_geo", "drop").when(F.col("rule").isNotNull(), "flag").otherwise("pass")
    return ev.select("event_id", rule.alias("rule")).select("event_id", "rule", act.alias("guard"))


def all_of(*holds: Column) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(h, F.lit(False)) for h in holds))


def any_of(*holds: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(h, F.lit(False)) for h in holds))


def not_(holds: Column) -> Column:
    return ~F.coalesce(holds, F.lit(False))


def formal_invariants(ev: DataFrame) -> DataFrame:
    """Violations of invariants over each actor's states (cumulative counts) and of their transitions, by invariant."""
    w = in_order().rowsBetween(W.unboundedPreceding, 0)
    x = ev.withColumns({"privileged": F.count(F.when(F.col("action") == "purchase", 1)).over(w), "errors": F.count(F.when(F.col("action") == "error", 1)).over(w), "n": F.count("*").over(w), "before": F.lag("action").over(in_order())})
    holds = {
        "bounded_privilege": any_of(F.col("n") < 10, F.col("privileged") * 2 <= F.col("n")), "few_errors": all_of(F.col("errors") <= 20, not_(F.col("errors") > F.col("n"))),
        "no_purchase_after_error": not_(all_of(F.col("before") == "error", F.col("action") == "purchase")),
    }
    broken = F.array_compact(F.array(*(F.when(~h, F.lit(n)) for n, h in holds.items())))
    return x.select("actor", F.explode(broken).alias("invariant")).groupBy("invariant").agg(F.count("*").alias("violations"), F.countDistinct("actor").alias("actors"))


def event_invariants(ev: DataFrame) -> DataFrame:
    """Checks between events, where a case is a signup, its response the next purchase of a case number (k) and its verification the next click: references must exist, verification
    may not come before response, two responses of a case may not be within the cooldown, and a value may not grow more than tenfold in one step."""
    case = ev.where("action = 'signup'").groupBy("k").agg(F.min("us").alias("opened"))
    response = ev.where("action = 'purchase'").select("event_id", "k", "us", "value")
    first = response.groupBy("k").agg(F.min("us").alias("answered"))
    check = ev.where("action = 'click'").select("event_id", "k", "us")
    orphan = response.join(case, "k", "left").where("opened is null or us < opened").select(F.lit("response_without_case").alias("invariant"), "event_id")
    early = check.join(first, "k", "left").where("answered is null or us < answered").select(F.lit("verified_before_response").alias("invariant"), "event_id")
    w = W.partitionBy("k").orderBy("us", "event_id")
    x = response.withColumns({"gap": F.col("us") - F.lag("us").over(w), "old": F.lag("value").over(w)})
    hasty = x.where(f"gap < {6 * HOUR}").select(F.lit("cooldown").alias("invariant"), "event_id")
    steep = x.where("value > 10 * old").select(F.lit("factor_bound").alias("invariant"), "event_id")
    return orphan.unionAll(early).unionAll(hasty).unionAll(steep)


def near_duplicates(ev: DataFrame, us: int = 12 * HOUR) -> DataFrame:
    """What stays where events of one actor, action and resource within a short time of the kept one go."""
    return first_in_period(ev, ["actor", "action", "resource"], us)


def fingerprints(ev: DataFrame) -> DataFrame:
    """Behaviour fingerprints (principal, action, resource), how often each occurs and over how long."""
    f = P.content_hash(F.col("actor"), F.col("action"), F.col("resource"), length=16)
    return ev.groupBy(f.alias("fingerprint")).agg(F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("span_us"))


def abuse_counters(ev: DataFrame, us: int = DAY, limit: int = 4) -> DataFrame:
    """Requests by address: all, the most in a sliding window, and how many came while the window held more than the limit."""
    w = W.partitionBy("ip").orderBy("us").rangeBetween(-us, 0)
    rows = ev.select("event_id", "ip", F.count("*").over(w).alias("n_window"))
    return rows.withColumn("over", F.col("n_window") > limit).groupBy("ip").agg(F.count("*").alias("n"), F.max("n_window").alias("peak"), F.count(F.when(F.col("over"), 1)).alias("n_over"))


def wrapped(ev: DataFrame) -> DataFrame:
    """Events as raw payloads, in turn plain, CloudEvents, a trail record, a queue body and a stream record; every third one is base64 or gzip on top. To test reading with."""
    e, s = F.col("event_id"), lambda c: c.cast("string")
    actor, resource = F.concat(F.lit("u"), s(F.col("actor"))), F.col("resource")
    plain = F.to_json(F.struct(F.lit("internal").alias("source"), F.lit("app").alias("service"), s(e).alias("event_id"), "action", actor.alias("actor"), "resource"))
    cloud = F.to_json(F.struct(F.lit("1.0").alias("specversion"), s(e).alias("id"), F.lit("okta").alias("source"), F.lit("app").alias("type"), actor.alias("subject"), F.struct("action", "resource").alias("data")))
    record = F.struct(s(e).alias("eventID"), F.col("action").alias("eventName"), F.struct(actor.alias("userName")).alias("userIdentity"), F.struct(resource.alias("resource")).alias("requestParameters"))
    trail = F.to_json(F.struct(F.array(record).alias("Records")))
    queue = F.to_json(F.struct(cloud.alias("body")))
    stream = F.to_json(F.struct(F.struct(F.base64(F.encode(plain, "UTF-8")).alias("data")).alias("kinesis")))
    text = F.when(e % 5 == 0, plain).when(e % 5 == 1, cloud).when(e % 5 == 2, trail).when(e % 5 == 3, queue).otherwise(stream)
    payload = F.when(e % 3 == 1, F.encode(F.base64(F.encode(text, "UTF-8")), "UTF-8")).otherwise(F.encode(text, "UTF-8"))
    return ev.select(payload.alias("payload"), e).select(F.when(F.col("event_id") % 3 == 2, gzipped("payload")).otherwise(F.col("payload")).alias("payload"))


def _e(f, *a):
    return lambda s, d: f(events(s, d), *a)


def _p(f, *a):
    return lambda s, d: f(placed(events(s, d)), *a)


def _enriched(s, d):
    ev = placed(events(s, d))
    people = ev.select("actor").distinct().where("actor % 4 != 3").withColumn("department", F.concat(F.lit("dept"), (F.col("actor") % 6).cast("string")))
    return enriched(ev, people, ev.select("ip").distinct().where("ip like '%.4'").withColumn("threat", F.lit("botnet")))


def _checked(s, d):
    made = opened(wrapped(events(s, d))).withColumn("source", F.when(F.col("event_id").cast("bigint") % 19 == 0, "nowhere").otherwise(F.col("source"))).withColumn("severity", F.when(F.col("event_id").cast("bigint") % 23 == 0, "grave").otherwise(F.col("severity")))
    return made.select(F.coalesce(schema_failure(made), F.lit("valid")).alias("failure")).groupBy("failure").agg(F.count("*").alias("n"))


QUERIES = {
    "p1_opened": lambda s, d: opened(wrapped(events(s, d))).select(F.col("event_id").cast("bigint").alias("event_id"), "envelope", "source", "service", "actor", "action", "resource"),
    "p9_canonical": lambda s, d: canonical(opened(wrapped(events(s, d)))).select("event_id", "source", "actor", "actor_type", "severity", F.size("tags").cast("bigint").alias("n_tags"), "enriched", "schema_version"),
    "p10_enriched": _enriched, "f2_schema": _checked, "f4_guarded": _p(guarded), "f9_formal": _e(formal_invariants), "f11_events": _e(event_invariants), "d3_near_duplicates": _e(near_duplicates), "d5_fingerprints": _e(fingerprints), "w19_abuse": _p(abuse_counters),
}
_ENVELOPES = "CASE event_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'cloudevents' WHEN 2 THEN 'cloudtrail' WHEN 3 THEN 'cloudevents' ELSE 'none' END"
_SOURCES = "CASE event_id % 5 WHEN 0 THEN 'internal' WHEN 1 THEN 'okta' WHEN 2 THEN 'aws' WHEN 3 THEN 'okta' ELSE 'internal' END"
_ORD = "OVER (PARTITION BY actor ORDER BY us, event_id"
ORACLE = {
    "p1_opened": EV + f" SELECT event_id, {_ENVELOPES} AS envelope, {_SOURCES} AS source, CASE WHEN event_id % 5 = 2 THEN 'cloudtrail' ELSE 'app' END AS service, 'u' || actor AS actor, action, resource FROM ev",
    "p9_canonical": EV + f" SELECT CAST(event_id AS VARCHAR) AS event_id, {_SOURCES} AS source, 'u' || actor AS actor, 'unknown' AS actor_type, 'info' AS severity, 0::BIGINT AS n_tags, false AS enriched, '2.0' AS schema_version FROM ev",
    "p10_enriched": PLACED + f" SELECT event_id, CASE WHEN actor % 4 = 3 THEN 'unknown' ELSE 'dept' || (actor % 6) END AS department, CASE WHEN ends_with(ip, '.4') THEN 'botnet' ELSE 'none' END AS threat, CASE WHEN k % 10 = 0 THEN 'crown_jewel' WHEN k % 3 = 0 THEN 'database' ELSE 'generic' END AS resource_class, substr(sha256(actor || ':' || ip || ':' || (us // {12 * HOUR})), 1, 16) AS session FROM pl",
    "f2_schema": EV + " SELECT CASE WHEN event_id % 19 = 0 THEN 'source' WHEN event_id % 23 = 0 THEN 'severity' ELSE 'valid' END AS failure, count(*) AS n FROM ev GROUP BY 1",
    "f4_guarded": PLACED + f""", p AS (SELECT *, lag(lat) {_ORD}) AS la, lag(lon) {_ORD}) AS lo, lag(us) {_ORD}) AS lu, count(*) FILTER (action = 'purchase') OVER (PARTITION BY actor ORDER BY us RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW) AS runs FROM pl),
 q AS (SELECT *, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)))) / greatest((us - lu) / {HOUR}.0, 1e-6), 3) AS kmh FROM p),
 r AS (SELECT event_id, CASE WHEN runs > 5 THEN 'rapid_escalation' WHEN kmh > 900 THEN 'impossible_geo' WHEN actor % 7 = 0 AND action = 'click' THEN 'service_interactive' END AS rule FROM q) SELECT event_id, rule, CASE rule WHEN 'rapid_escalation' THEN 'halt' WHEN 'impossible_geo' THEN 'drop' WHEN 'service_interactive' THEN 'flag' ELSE 'pass' END AS guard FROM r""",
    "f9_formal": EV + f""", x AS (SELECT *, count(*) FILTER (action = 'purchase') {_ORD}) AS pv, count(*) FILTER (action = 'error') {_ORD}) AS er, count(*) {_ORD}) AS n, lag(action) {_ORD}) AS b FROM ev),
 v AS (SELECT actor, 'bounded_privilege' AS invariant FROM x WHERE NOT (n < 10 OR pv * 2 <= n) UNION ALL SELECT actor, 'few_errors' FROM x WHERE er > 20 UNION ALL SELECT actor, 'no_purchase_after_error' FROM x WHERE b = 'error' AND action = 'purchase') SELECT invariant, count(*) AS violations, count(DISTINCT actor) AS actors FROM v GROUP BY 1""",
    "f11_events": EV + f""", cs AS (SELECT k, min(us) AS o FROM ev WHERE action = 'signup' GROUP BY k), rs AS (SELECT *, us - lag(us) OVER (PARTITION BY k ORDER BY us, event_id) AS gap, lag(value) OVER (PARTITION BY k ORDER BY us, event_id) AS old FROM ev WHERE action = 'purchase'), fr AS (SELECT k, min(us) AS a FROM rs GROUP BY k)
 SELECT 'response_without_case' AS invariant, event_id FROM rs LEFT JOIN cs USING (k) WHERE o IS NULL OR us < o UNION ALL SELECT 'verified_before_response', event_id FROM ev LEFT JOIN fr USING (k) WHERE action = 'click' AND (a IS NULL OR us < a)
 UNION ALL SELECT 'cooldown', event_id FROM rs WHERE gap < {6 * HOUR} UNION ALL SELECT 'factor_bound', event_id FROM rs WHERE value > 10 * old""",
    "d3_near_duplicates": EV.replace("WITH ev", "WITH RECURSIVE ev") + f""", o AS (SELECT *, row_number() OVER (PARTITION BY actor, action, resource ORDER BY us, event_id) AS rn FROM ev),
 r AS (SELECT actor, action, resource, event_id, rn, us AS last, true AS keep FROM o WHERE rn = 1 UNION ALL SELECT o.actor, o.action, o.resource, o.event_id, o.rn, CASE WHEN o.us - r.last > {12 * HOUR} THEN o.us ELSE r.last END, o.us - r.last > {12 * HOUR} FROM r JOIN o ON o.actor = r.actor AND o.action = r.action AND o.resource = r.resource AND o.rn = r.rn + 1)
 SELECT actor, action, resource, event_id FROM r WHERE keep""",
    "d5_fingerprints": EV + " SELECT substr(sha256(actor || ':' || action || ':' || resource), 1, 16) AS fingerprint, count(*) AS n, max(us) - min(us) AS span_us FROM ev GROUP BY 1",
    "w19_abuse": PLACED + f" SELECT ip, count(*) AS n, max(w) AS peak, count(*) FILTER (w > 4) AS n_over FROM (SELECT ip, count(*) OVER (PARTITION BY ip ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS w FROM pl) GROUP BY ip",
}
