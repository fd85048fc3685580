"""Parsing, validation, guards and deduplication of events and texts. Everything is an expression or one keyed window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brinewatch.functions import predicates as P
from brinewatch.operators.ledger import with_previous
from brinewatch.operators.windows import PLACED, placed
from brinewatch.sources.tables import DAY, EV, HOUR, events, read


def normalised(ev: DataFrame) -> DataFrame:
    """Canonical events: names, kinds, severity and tags."""
    action = P.renamed(F.col("action"), P.ACTION_NAMES)
    actor = F.concat(F.element_at(F.array(F.lit("svc-service-"), F.lit("role/"), F.lit("u@")), (F.col("actor") % 3 + 1).cast("int")), F.col("actor").cast("string"))
    x = ev.select("event_id", P.first_valid(F.lit(" "), actor).alias("actor"), action.alias("action"), F.lower("resource").alias("resource"), "value")
    found = P.tags(no_mfa=F.col("value") < 5, high_risk_login=F.col("action") == "create_user", finding=F.col("value") > 50)
    return x.select("event_id", "actor", P.actor_kind(F.col("actor")).alias("actor_kind"), "action", "resource", P.severity(F.lit(None).cast("string"), F.col("action")).alias("severity"), F.array_join(found, ",").alias("tags"))


def validated(ev: DataFrame, now: Column) -> DataFrame:
    """Rows with the first check they fail as reason (null: valid); ev has us, resource, ip."""
    reason = P.first_failure(
        action=F.col("action").isin("view", "click", "purchase", "signup"), too_old=F.col("us") >= now - 25 * DAY, future=F.col("us") <= now - 12 * HOUR,
        resource=F.length("resource") >= 6, ip=P.ipv4(F.col("ip")).isNotNull(), blocked=~F.col("resource").isin("res-13", "res-66"),
    )
    return ev.withColumn("reason", reason)


def split_validity(ev: DataFrame) -> DataFrame:
    """How many rows are valid, and how many went to the dead letters for each reason."""
    now = ev.agg(F.max("us").alias("now"))
    return validated(ev.crossJoin(F.broadcast(now)), F.col("now")).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def injections(texts: DataFrame, key: list[str]) -> DataFrame:
    """Texts with suspicious substrings: how many different ones, the first, and the text sanitised."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = F.array_compact(F.array(*(F.when(low.contains(p), F.lit(p)) for p in P.INJECTIONS)))
    return texts.select(*key, F.size(hits).cast("bigint").alias("n_hits"), F.try_element_at(hits, F.lit(1)).alias("first_hit"), F.length(F.regexp_replace("text", "[<>$]", "")).cast("bigint").alias("clean_chars")).where("n_hits > 0")


def planted(texts: DataFrame) -> DataFrame:
    """Texts of which every seventh conversation's even turns carry an injected phrase, so there is something to find."""
    bad = (F.col("conv_id") % 7 == 0) & (F.col("turn") % 2 == 0)
    phrase = F.element_at(F.array(*map(F.lit, P.INJECTIONS)), (F.col("conv_id") / 7 % len(P.INJECTIONS)).cast("int") + 1)
    return texts.withColumn("text", F.when(bad, F.concat("text", F.lit(" "), F.upper(phrase))).otherwise(F.col("text")))


def first_in_period(ev: DataFrame, keys: list[str], us: int, more: list[str] | None = None) -> DataFrame:
    """(*keys, event_id) of what stays where duplicates within us of the first sight of a key go; a period begins at the first event after the last one's end.

    With more, these columns come along, and all rows of a key and event that stays stay.
    What stays depends on what stayed before, so each key's times are read in order, as a stream: a task holds a batch and the last kept time.
    """
    schema = ev.select(*keys, F.col("us").cast("bigint").alias("us"), F.col("event_id").cast("bigint").alias("event_id"), *(more or ()))

    def changes(c: pa.Array) -> np.ndarray:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        return pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, event = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            columns, times = [b.column(k) for k in keys], b.column("us").to_numpy()
            events = b.column("event_id").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.logical_or.reduce([changes(c) for c in columns])) + 1).tolist(), b.num_rows]
            chosen = []

            def same(i: int, e: int, times: np.ndarray = times, events: np.ndarray = events, chosen: list[int] = chosen) -> None:
                """The further rows from i on of the event kept last."""
                while more is not None and i < e and times[i] == last and events[i] == event:
                    chosen.append(i)
                    i += 1

            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if (name := tuple(c[s].as_py() for c in columns)) != key:
                    key, last = name, None
                if last is not None:
                    same(s, e)
                i = s if last is None else s + int(np.searchsorted(times[s:e], last + us, "right"))
                while i < e:
                    chosen.append(i)
                    last, event = int(times[i]), events[i]
                    same(i + 1, e)
                    i = s + int(np.searchsorted(times[s:e], last + us, "right"))
            yield b.take(pa.array(chosen, pa.int64()))

    ordered = schema.repartition(*keys).sortWithinPartitions(*keys, "us", "event_id")
    return ordered.mapInArrow(kept, schema.schema).drop("us")


def content_duplicates(ev: DataFrame) -> DataFrame:
    """One row per content hash: the first event, and how many there are."""
    h = P.content_hash(F.col("actor"), F.col("action"), F.col("resource"))
    return ev.withColumn("hash", h).groupBy("hash").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


def suppressed(ev: DataFrame, actors: DataFrame) -> DataFrame:
    """Events of actors that aren't on the list."""
    return ev.join(actors, "actor", "left_anti")


def nonces(ev: DataFrame, us: int = 10 * DAY) -> DataFrame:
    """Replays: a nonce (the resource) used again by any actor within the window."""
    w = W.partitionBy("resource").orderBy("us", "event_id")
    return ev.withColumn("d", F.col("us") - F.lag("us").over(w)).where(F.col("d") <= us).groupBy("actor").agg(F.count("*").alias("n_replays"))


def invariants(ev: DataFrame) -> DataFrame:
    """Violations of: ids unique, times not falling with ids, at most a share of purchases, no value below 0."""
    back = with_previous(ev.select(F.col("event_id").alias("seq"), "us"), "us", "before").where("us < before")
    a = ev.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("d"), F.count(F.when(F.col("action") == "purchase", 1)).alias("p"), F.count(F.when(F.col("value") < 0, 1)).alias("neg"))
    rows = a.select(F.explode(F.array(F.struct(F.lit("unique_ids").alias("invariant"), (F.col("n") - F.col("d")).alias("violations")), F.struct(F.lit("few_purchases").alias("invariant"), F.greatest(F.col("p") * 10 - F.col("n"), F.lit(0).cast("bigint")).alias("violations")), F.struct(F.lit("no_negative").alias("invariant"), F.col("neg").alias("violations")))).alias("x")).select("x.*")
    return rows.unionAll(back.agg(F.lit("monotonic").alias("invariant"), F.count("*").alias("violations")))


def parsed_methods(ev: DataFrame) -> DataFrame:
    name = F.concat(F.lit("google.iam.v1.projects/p"), (F.col("k") % 5).cast("string"), F.lit("/Svc."), F.col("action"))
    token = F.concat(F.lit("tok-"), F.col("event_id").cast("string"), F.col("resource"))
    return ev.select("event_id", P.short_method(name).alias("method"), F.regexp_extract(name, "projects/([^/]*)", 1).alias("project"), P.masked(token).alias("token"))


def cidr_misses(ev: DataFrame) -> DataFrame:
    """Events from outside the actor's network; ev has ip."""
    net = F.concat(F.lit("10."), (F.col("actor") % 4).cast("string"), F.lit(".0.0"))
    return ev.where(~P.in_cidr(F.col("ip"), net, F.lit(16))).groupBy("actor").agg(F.count("*").alias("n_outside"))


def rejected(ev: DataFrame) -> DataFrame:
    """Every rejected row with its reason and what a replay needs."""
    now = ev.agg(F.max("us").alias("now"))
    return validated(ev.crossJoin(F.broadcast(now)), F.col("now")).where("reason is not null").select("reason", "event_id", "us", "actor", "action", "resource", "value", "ip")


def dead_letters(ev: DataFrame) -> DataFrame:
    """A look at the newest two rejected rows of each reason."""
    return rejected(ev).withColumn("place", F.row_number().over(W.partitionBy("reason").orderBy(F.desc("us"), F.desc("event_id"))).cast("bigint")).where("place <= 2").select("reason", "place", "event_id")


def _p(f):
    return lambda s, d: f(placed(events(s, d)))


QUERIES = {
    "p_normalised": lambda s, d: normalised(events(s, d)),
    "p11_parsed_methods": lambda s, d: parsed_methods(events(s, d)),
    "f1_validation": _p(split_validity),
    "s18_dead_letters": _p(dead_letters),
    "s18_rejected": _p(rejected),
    "f3_injections": lambda s, d: injections(planted(read(s, d, "conversations")), ["conv_id", "turn"]),
    "f3_nonces": lambda s, d: nonces(events(s, d)),
    "f5_suppressed": lambda s, d: suppressed(events(s, d), events(s, d).where("action = 'error' and value > 30").select("actor").distinct()).groupBy("actor").agg(F.count("*").alias("n")),
    "f10_invariants": lambda s, d: invariants(events(s, d)),
    "d1_first_in_period": lambda s, d: first_in_period(events(s, d), ["actor", "action"], 3 * DAY),
    "d2_content_duplicates": lambda s, d: content_duplicates(events(s, d)),
    "a3_cidr_misses": _p(cidr_misses),
}

_REASON = f"""CASE WHEN action NOT IN ('view', 'click', 'purchase', 'signup') THEN 'action' WHEN us < now - {25 * DAY} THEN 'too_old' WHEN us > now - {12 * HOUR} THEN 'future' WHEN length(resource) < 6 THEN 'resource'
 WHEN resource IN ('res-13', 'res-66') THEN 'blocked' END"""
_LIST = ", ".join("'" + p.replace("'", "''") + "'" for p in P.INJECTIONS)
ORACLE = {
    "p_normalised": EV + """, x AS (SELECT event_id, ['svc-service-', 'role/', 'u@'][actor % 3 + 1] || actor AS actor, actor % 3 AS m, CASE action WHEN 'view' THEN 'read' WHEN 'click' THEN 'invoke' WHEN 'purchase' THEN 'assume_role' WHEN 'signup' THEN 'create_user' WHEN 'error' THEN 'access_denied' ELSE action END AS action, resource, value FROM ev)
 SELECT event_id, actor, ['service', 'role', 'user'][m + 1] AS actor_kind, action, resource, CASE WHEN action IN ('assume_role', 'create_user') THEN 'high' ELSE 'info' END AS severity,
 concat_ws(',', CASE WHEN value < 5 THEN 'no_mfa' END, CASE WHEN action = 'create_user' THEN 'high_risk_login' END, CASE WHEN value > 50 THEN 'finding' END) AS tags FROM x""",
    "p11_parsed_methods": EV + " SELECT event_id, action AS method, 'p' || (k % 5) AS project, 'tok-' || '****' || right('tok-' || event_id || resource, 4) AS token FROM ev",
    "f1_validation": PLACED + f" SELECT coalesce(r, 'valid') AS reason, count(*) AS n FROM (SELECT {_REASON} AS r FROM (SELECT *, max(us) OVER () AS now FROM pl)) GROUP BY 1",
    "s18_dead_letters": PLACED + f" SELECT reason, place, event_id FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY us DESC, event_id DESC) AS place FROM (SELECT *, {_REASON} AS reason FROM (SELECT *, max(us) OVER () AS now FROM pl)) WHERE reason IS NOT NULL) WHERE place <= 2",
    "f3_injections": f"SELECT conv_id, turn, CAST(len(h) AS BIGINT) AS n_hits, h[1] AS first_hit, CAST(length(regexp_replace(text, '[<>$]', '', 'g')) AS BIGINT) AS clean_chars FROM (SELECT *, list_filter([{_LIST}], lambda p: contains(lower(coalesce(text, '')), p)) AS h FROM (SELECT * REPLACE (CASE WHEN conv_id % 7 = 0 AND turn % 2 = 0 THEN text || ' ' || upper([{_LIST}][conv_id // 7 % {len(P.INJECTIONS)} + 1]) ELSE text END AS text) FROM conversations)) WHERE len(h) > 0",
    "f3_nonces": EV + f" SELECT actor, count(*) AS n_replays FROM (SELECT *, us - lag(us) OVER (PARTITION BY resource ORDER BY us, event_id) AS d FROM ev) WHERE d <= {10 * DAY} GROUP BY actor",
    "f5_suppressed": EV + " SELECT actor, count(*) AS n FROM ev WHERE actor NOT IN (SELECT actor FROM ev WHERE action = 'error' AND value > 30) GROUP BY actor",
    "f10_invariants": EV + """ SELECT 'unique_ids' AS invariant, count(*) - count(DISTINCT event_id) AS violations FROM ev UNION ALL SELECT 'few_purchases', greatest(count(*) FILTER (action = 'purchase') * 10 - count(*), 0) FROM ev
 UNION ALL SELECT 'no_negative', count(*) FILTER (value < 0) FROM ev UNION ALL SELECT 'monotonic', count(*) FROM (SELECT us, lag(us) OVER (ORDER BY event_id) AS b FROM ev) WHERE us < b""",
    "d1_first_in_period": EV.replace("WITH ev", "WITH RECURSIVE ev") + f""", o AS (SELECT *, row_number() OVER (PARTITION BY actor, action ORDER BY us, event_id) AS rn FROM ev),
 r AS (SELECT actor, action, event_id, us, rn, us AS last, true AS keep FROM o WHERE rn = 1 UNION ALL SELECT o.actor, o.action, o.event_id, o.us, o.rn, CASE WHEN o.us - r.last > {3 * DAY} THEN o.us ELSE r.last END, o.us - r.last > {3 * DAY} FROM r JOIN o ON o.actor = r.actor AND o.action = r.action AND o.rn = r.rn + 1)
 SELECT actor, action, event_id FROM r WHERE keep""",
    "d2_content_duplicates": EV + " SELECT substr(sha256(actor || ':' || action || ':' || resource), 1, 20) AS hash, min(event_id) AS first_event, count(*) AS n FROM ev GROUP BY 1",
    "a3_cidr_misses": PLACED + " SELECT actor, count(*) AS n_outside FROM pl WHERE k % 4 <> actor % 4 GROUP BY actor",
}
