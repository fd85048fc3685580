"""Event ledgers: chain verification, Merkle roots, replayed state, gaps, snapshots, votes; and policies over events.

Verification needs no sequential pass: each record is checked against its predecessor by lag within ranges of sequence numbers, whose
first rows look at the last range before that has records, through one more window over the ranges' ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brinewatch.functions.prefix import sums_before, value_before
from brinewatch.sources.tables import EV, cut, events

GENESIS = "0" * 64
RANGE = 10_000


def records(ev: DataFrame) -> DataFrame:
    """A ledger of events: each record's hash covers its content; damage is put in at fixed places, so there is something to find."""
    content = F.concat_ws("|", F.col("event_id").cast("string"), F.col("actor").cast("string"), "action", "resource")
    h = F.sha2(content, 256)
    seq = F.col("event_id")
    stored = F.when(seq % 97 == 13, F.sha2(F.concat(h, F.lit("x")), 256)).otherwise(h)
    return ev.where(seq % 211 != 17).select(seq.alias("seq"), "us", "actor", "action", "resource", "k", "value", content.alias("content"), stored.alias("record_hash"))


def with_previous(df: DataFrame, column: str, name: str) -> DataFrame:
    """The column of the record before, over all sequence numbers, without ordering everything in one task."""
    part = F.floor(F.col("seq") / RANGE)
    w = W.partitionBy("_part").orderBy("seq")
    df = df.withColumn("_part", part)
    ends = df.groupBy("_part").agg(F.max_by(column, "seq").alias("_last"))  # one row a range that has records
    ends = value_before(ends, "_part", "_last", "_end").select("_part", "_end")  # ranges without any are passed over
    return df.join(ends, "_part", "left").withColumn(name, F.coalesce(F.lag(column).over(w), F.when(F.row_number().over(w) == 1, F.col("_end")))).drop("_part", "_end")


def numbered(df: DataFrame, *ties: str) -> DataFrame:
    """Each record's place i from 0 in the order of seq (equal ones by ties): places within ranges, and the sizes of the ranges before."""
    df = df.withColumn("_part", F.floor(F.col("seq") / RANGE))
    sizes = sums_before(df.groupBy("_part").agg(F.count("*").alias("_n")), "_part", {"_before": "_n"}).select("_part", "_before")  # one row a range
    return df.join(sizes, "_part").withColumn("i", F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy("seq", *ties)) - 1).drop("_part", "_before")


def verified(ledger: DataFrame) -> DataFrame:
    """Sequence gaps and hashes that don't fit, by record."""
    x = with_previous(ledger, "seq", "before")
    found = F.array_compact(F.array(F.when(F.col("seq") != F.col("before") + 1, F.lit("SEQUENCE_GAP")), F.when(F.sha2("content", 256) != F.col("record_hash"), F.lit("HASH_MISMATCH"))))
    return x.select("seq", F.explode(found).alias("error"))


def merkle_root(leaves: DataFrame) -> DataFrame:
    """The root over (i from 0, h): neighbours hash together, an odd last one with itself; each level halves the rows."""
    n = leaves.count()
    level = leaves
    while n > 1:
        pair = level.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.min_by("h", "i").alias("l"), F.max_by("h", "i").alias("r"))
        level = pair.select("i", F.sha2(F.concat("l", "r"), 256).alias("h"))
        n = -(-n // 2)
        if n > 64:
            level = cut(level)
    return level.select(F.col("h").alias("root"))


def ledger_root(ledger: DataFrame) -> DataFrame:
    """The Merkle root of all records; a leaf covers all that is stored of a record."""
    leaf = F.sha2(F.to_json(F.struct("seq", "us", "actor", "action", "resource", "value", "content", "record_hash")), 256)
    return merkle_root(cut(numbered(ledger.select("seq", leaf.alias("h")), "h").select("i", "h")))


def state_at(ledger: DataFrame, until: int | None = None) -> DataFrame:
    """The state that replaying up to a sequence number gives: counts, last action, set sizes of each actor."""
    x = ledger if until is None else ledger.where(F.col("seq") <= until)
    return x.groupBy("actor").agg(F.count("*").alias("n"), F.count(F.when(F.col("action") == "purchase", 1)).alias("assumed"), F.max_by("action", "seq").alias("last_action"), F.max("seq").alias("last_seq"), F.countDistinct("resource").alias("resources"))


def divergence(ledger: DataFrame) -> DataFrame:
    """Actors whose state differs between a shadow rebuild that skips errors and the live state."""
    live, shadow = state_at(ledger), state_at(ledger.where("action != 'error'"))
    b = shadow.select("actor", F.col("n").alias("m"), F.col("last_action").alias("other"))
    return live.join(b, "actor", "full").where(~F.col("n").eqNullSafe(F.col("m")) | ~F.col("last_action").eqNullSafe(F.col("other"))).select("actor", "n", F.coalesce("m", F.lit(0)).alias("shadow_n"), "last_action", "other")


def gaps(ledger: DataFrame) -> DataFrame:
    """Missing stretches of sequence numbers."""
    return with_previous(ledger, "seq", "before").where("seq > before + 1").select((F.col("before") + 1).alias("first"), (F.col("seq") - 1).alias("last"))


LEGAL = (("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"), ("purchase", "view"), ("signup", "view"))


def transitions(ledger: DataFrame) -> DataFrame:
    """Changes of state that the table of legal ones lacks, counted."""
    w = W.partitionBy("actor").orderBy("seq")
    legal = ledger.sparkSession.createDataFrame(LEGAL, "before string, action string")
    return ledger.withColumn("before", F.lag("action").over(w)).where("before is not null").join(F.broadcast(legal), ["before", "action"], "left_anti").groupBy("before", "action").agg(F.count("*").alias("n"))


def nearest_snapshots(ledger: DataFrame, every: int = 250) -> DataFrame:
    """For each actor's last record the snapshot before it and how many records follow that."""
    last = ledger.groupBy("actor").agg(F.max("seq").alias("seq"))
    snap = F.floor(F.col("seq") / every) * every
    s = last.select("actor", "seq", snap.alias("snapshot"))
    d = ledger.select("actor", F.col("seq").alias("x")).join(s, "actor").where("x > snapshot").groupBy("actor", "snapshot").agg(F.count("*").alias("delta"))
    return s.join(d, ["actor", "snapshot"], "left").select("actor", "snapshot", F.coalesce("delta", F.lit(0)).alias("delta"))


def consensus(ledger: DataFrame, share: float = 0.5) -> DataFrame:
    """Votes (value over 15) of actors on resources: an actor's last vote counts; accepted at three voters and a share for; equivocators voted both ways."""
    v = ledger.withColumn("vote", F.col("value") > 15).groupBy("resource", "actor").agg(F.max_by("vote", "seq").alias("vote"), (F.min("vote") != F.max("vote")).alias("both"))
    a = v.groupBy("resource").agg(F.count("*").alias("voters"), F.count(F.when(F.col("vote"), 1)).alias("yes"), F.count(F.when(F.col("both"), 1)).alias("equivocators"))
    return a.withColumn("accepted", (F.col("voters") >= 3) & (F.col("yes") >= share * F.col("voters")))


# Policies


def condition(column: Column, text: str) -> Column:
    """A predicate from policy text; the longest operator is tried first, a missing value never holds."""
    for op, f in ((">=", lambda c, v: c >= v), ("<=", lambda c, v: c <= v), ("==", lambda c, v: c == v), ("!=", lambda c, v: c != v), (">", lambda c, v: c > v), ("<", lambda c, v: c < v)):
        if text.startswith(op):
            v = text[len(op) :].strip()
            number = v.replace(".", "", 1).lstrip("-").isdigit()
            return F.coalesce(f(column.cast("double") if number else F.lower(column.cast("string")), float(v) if number else v.lower()), F.lit(False))
    if text.startswith("between:"):
        lo, hi = map(float, text.split(":")[1:])
        return F.coalesce(column.cast("double").between(lo, hi), F.lit(False))
    if text.startswith("regex:"):
        return F.coalesce(column.cast("string").rlike(text[6:]), F.lit(False))
    if text.startswith("contains:"):
        return F.coalesce(F.lower(column.cast("string")).contains(text[9:].lower()), F.lit(False))
    if text.startswith("in:"):
        return F.coalesce(F.lower(column.cast("string")).isin(*text[3:].lower().split(",")), F.lit(False))
    return F.coalesce(F.lower(column.cast("string")) == text.lower(), F.lit(False))


POLICIES = (
    (1, "deny_errors", {"action": "error", "value": ">=25"}, "deny"), (2, "review_resources", {"resource": "regex:^res-[0-9]$"}, "review"), (3, "quarantine", {"action": "in:purchase,signup", "value": "between:5:20"}, "quarantine"),
    (4, "watch", {"resource": "contains:7", "value": "<10"}, "watch"),
)


def decided(ev: DataFrame) -> DataFrame:
    """The first policy by priority whose conditions all hold; audit where none does; and how many hold."""
    rule, verdict, n = F.lit(None).cast("string"), F.lit("audit"), F.lit(0).cast("bigint")
    for _, name, fields, decision in sorted(POLICIES, reverse=True):
        ok = F.lit(True)
        for field, text in fields.items():
            ok = ok & condition(F.col(field), text)
        rule, verdict, n = F.when(ok, name).otherwise(rule), F.when(ok, decision).otherwise(verdict), n + F.when(ok, 1).otherwise(0)
    return ev.select("event_id", rule.alias("policy"), verdict.alias("decision"), n.alias("n_matches"))


def plans(ev: DataFrame) -> DataFrame:
    """Mitigation plans by actor: distinct decisions in order, their hash, and whether a person must look."""
    d = decided(ev).where("policy is not null").join(ev.select("event_id", "actor"), "event_id").groupBy("actor").agg(F.array_join(F.array_sort(F.collect_set("decision")), ",").alias("actions"), F.count("*").alias("n"))
    return d.select("actor", "actions", "n", F.substring(F.sha2(F.concat(F.col("actor").cast("string"), F.lit(":"), "actions"), 256), 1, 16).alias("plan_id"), F.col("actions").contains("quarantine").alias("review"))


def streaks(ev: DataFrame) -> DataFrame:
    """Each actor's longest run of events without an error."""
    w = W.partitionBy("actor").orderBy("us", "event_id")
    x = ev.withColumn("island", F.sum(F.when(F.col("action") == "error", 1).otherwise(0)).over(w)).where("action != 'error'")
    return x.groupBy("actor", "island").agg(F.count("*").alias("n")).groupBy("actor").agg(F.max("n").alias("longest"))


def _l(f, *a):
    return lambda s, d: f(records(events(s, d)), *a)


def _e(f, *a):
    return lambda s, d: f(events(s, d), *a)


QUERIES = {
    "l2_verified": _l(verified), "l3_ledger_root": _l(ledger_root), "l9_gaps": _l(gaps), "l11_divergence": _l(divergence), "l13_transitions": _l(transitions), "l14_nearest_snapshots": _l(nearest_snapshots),
    "l16_consensus": _l(consensus), "q4_decided": _e(decided), "q5_plans": _e(plans), "q7_streaks": _e(streaks),
}

_LED = EV + """, lg AS (SELECT event_id AS seq, us, actor, action, resource, k, value, concat_ws('|', event_id, actor, action, resource) AS content, sha256(concat_ws('|', event_id, actor, action, resource)) AS h FROM ev WHERE event_id % 211 <> 17),
 ld AS (SELECT *, CASE WHEN seq % 97 = 13 THEN sha256(h || 'x') ELSE h END AS record_hash, lag(seq) OVER (ORDER BY seq) AS before FROM lg)"""
_STATE = "count(*) AS n, count(*) FILTER (action = 'purchase') AS assumed, max_by(action, seq) AS last_action, max(seq) AS last_seq, count(DISTINCT resource) AS resources"
_DEC = EV + """, mt AS (SELECT *, action = 'error' AND value >= 25 AS a, regexp_matches(resource, '^res-[0-9]$') AS b, action IN ('purchase', 'signup') AND value BETWEEN 5 AND 20 AS c, contains(resource, '7') AND value < 10 AS d FROM ev),
 de AS (SELECT event_id, actor, CASE WHEN a THEN 'deny_errors' WHEN b THEN 'review_resources' WHEN c THEN 'quarantine' WHEN d THEN 'watch' END AS policy, CASE WHEN a THEN 'deny' WHEN b THEN 'review' WHEN c THEN 'quarantine' WHEN d THEN 'watch' ELSE 'audit' END AS decision, CAST(a::INT + b::INT + c::INT + d::INT AS BIGINT) AS n_matches FROM mt)"""


ORACLE = {
    "l2_verified": _LED + " SELECT seq, 'SEQUENCE_GAP' AS error FROM ld WHERE seq <> before + 1 UNION ALL SELECT seq, 'HASH_MISMATCH' FROM ld WHERE sha256(content) <> record_hash",
    "l9_gaps": _LED + " SELECT before + 1 AS first, seq - 1 AS last FROM ld WHERE seq > before + 1",
    "l11_divergence": _LED + f""", a AS (SELECT actor, {_STATE} FROM ld GROUP BY actor), b AS (SELECT actor, {_STATE} FROM ld WHERE action <> 'error' GROUP BY actor)
 SELECT actor, a.n, coalesce(b.n, 0) AS shadow_n, a.last_action, b.last_action AS other FROM a LEFT JOIN b USING (actor) WHERE a.n IS DISTINCT FROM b.n OR a.last_action IS DISTINCT FROM b.last_action""",
    "l13_transitions": _LED + " SELECT b AS before, action, count(*) AS n FROM (SELECT action, lag(action) OVER (PARTITION BY actor ORDER BY seq) AS b FROM ld) WHERE b IS NOT NULL AND (b, action) NOT IN (" + ", ".join(map(str, LEGAL)) + ") GROUP BY ALL",
    "l14_nearest_snapshots": _LED + ", s AS (SELECT actor, max(seq) // 250 * 250 AS snapshot FROM ld GROUP BY actor) SELECT actor, any_value(snapshot) AS snapshot, count(*) FILTER (seq > snapshot) AS delta FROM ld JOIN s USING (actor) GROUP BY actor",
    "l16_consensus": _LED + ", v AS (SELECT resource, actor, max_by(value > 15, seq) AS vote, min(value > 15) <> max(value > 15) AS b FROM ld GROUP BY ALL) SELECT resource, count(*) AS voters, count(*) FILTER (vote) AS yes, count(*) FILTER (b) AS equivocators, count(*) >= 3 AND count(*) FILTER (vote) >= 0.5 * count(*) AS accepted FROM v GROUP BY resource",
    "q4_decided": _DEC + " SELECT event_id, policy, decision, n_matches FROM de",
    "q5_plans": _DEC + ", p AS (SELECT actor, array_to_string(list_sort(list(DISTINCT decision)), ',') AS actions, count(*) AS n FROM de WHERE policy IS NOT NULL GROUP BY actor) SELECT *, substr(sha256(actor || ':' || actions), 1, 16) AS plan_id, contains(actions, 'quarantine') AS review FROM p",
    "q7_streaks": EV + ", x AS (SELECT *, sum((action = 'error')::INT) OVER (PARTITION BY actor ORDER BY us, event_id) AS i FROM ev) SELECT actor, max(n) AS longest FROM (SELECT actor, i, count(*) AS n FROM x WHERE action <> 'error' GROUP BY ALL) GROUP BY actor",
}
