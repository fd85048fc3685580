"""State by event type, with its whole history: a registry of reducers over a table of intervals.

A reducer is a list of changes: (operation, kind of entity, its key, a field, a value), the last three as SQL over the payload's fields. Each change of an entity's field opens an
interval that the next one closes: (kind, key, field, element, value, seq_from, ts_from, seq_to, ts_to), with nulls where it is still open. Elements are members of a list or set field, each
with intervals of its own, so no row grows. What the state was at any number or time, between two, what a rollback leaves and what differs are range look-ups.

Intervals come from one sorted stream an entity, which holds that entity's present fields only. Logs over all events (accesses, role assumptions) have no entity: their last LOG_CAP entries count, so
an entry ends where the one LOG_CAP places later begins, found by joining places.

Operations: reset (the entity starts anew, without fields), set, exist (set, if there is such an entity), init (set, if there was none before this event), first (set, if the field has no value), count
(one more), add (a member, unless it is one), remove, append (a member always new), log. All but exist bring an entity about.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brinewatch.operators import ledger
from brinewatch.sources.tables import EV, cut, events

LOG_CAP = 10_000
#: Members that a field keeps at most; the oldest goes.
CAPS = {("identities", "ips"): 50}
FIELDS = "event_id event_type action actor resource timestamp ip region policy_arn policy_document access_key_id status token identity new_role principal severity service compliance".split()


@dataclass(frozen=True)
class Change:
    op: str
    kind: str
    key: str
    field: str = ""
    value: str = "''"


def sets(kind: str, key: str, **values: str) -> list[Change]:
    return [Change("set", kind, key, f, v) for f, v in values.items()]


def entry(log: str, *parts: str) -> Change:
    return Change("log", log, "''", "entries", " || '|' || ".join(f"coalesce({p}, '')" for p in parts))


ACTOR, RESOURCE, TS, TARGET = "coalesce(actor, 'unknown')", "coalesce(resource, '')", "coalesce(timestamp, '')", "coalesce(resource, actor, 'unknown')"
KEY_ID = "coalesce(access_key_id, resource, '')"
_LOGIN = [
    Change("init", "identities", ACTOR, "mfa", "'false'"), Change("init", "identities", ACTOR, "first_seen", TS), Change("count", "identities", ACTOR, "logins"),
    *sets("identities", ACTOR, active="'true'", last_login=TS, last_action="coalesce(action, 'login')"), Change("add", "identities", ACTOR, "ips", "ip"), Change("add", "identities", ACTOR, "regions", "region"),
]
_ASSUME = [Change("count", "role_assumptions", ACTOR, "count"), *sets("role_assumptions", ACTOR, last_ts=TS), Change("add", "role_assumptions", ACTOR, "roles", RESOURCE), entry("role_assumption_log", "actor", "resource", "timestamp", "ip", "region")]
_NEW_KEY = [Change("reset", "access_keys", KEY_ID), *sets("access_keys", KEY_ID, created_by=ACTOR, created_at=TS, active="'true'", revoked="'false'", target=RESOURCE)]
_END_KEY = [Change("exist", "access_keys", KEY_ID, f, v) for f, v in (("active", "'false'"), ("deleted", "'true'"))]
_ACCESS = [entry("access_log", "actor", "resource", "action", "timestamp", "ip", "region"), Change("count", "resource_access_counts", RESOURCE, "count")]
_THREAT = [Change("reset", "active_findings", "event_id"), *sets("active_findings", "event_id", source="coalesce(service, 'guardduty')", severity="coalesce(severity, 'medium')", actor="coalesce(actor, '')", resource=RESOURCE, ts=TS, resolved="'false'")]
_COMPLIANCE = [Change("reset", "compliance_findings", "event_id"), *sets("compliance_findings", "event_id", source="coalesce(service, 'securityhub')", severity="coalesce(severity, 'medium')", compliance="coalesce(compliance, '')", resource=RESOURCE, ts=TS, resolved="'false'")]
_DELETED = lambda kind: [Change("exist", kind, RESOURCE, f, v) for f, v in (("deleted", "'true'"), ("deleted_by", ACTOR), ("deleted_at", TS))]
_POLICIES = Change("touch", "roles", RESOURCE)
_ESCALATING, _NEW_ROLE = "coalesce(actor, identity, 'unknown')", "coalesce(new_role, resource, '')"

#: Event types and what each does.
REDUCERS: dict[str, list[Change]] = {
    "login": _LOGIN, "ConsoleLogin": _LOGIN,
    "logout": sets("identities", ACTOR, active="'false'", last_logout=TS),
    "CreateUser": [Change("reset", "identities", RESOURCE), *sets("identities", RESOURCE, created_by=ACTOR, created_at=TS, logins="'0'", active="'false'", disabled="'false'", mfa="'false'"), entry("identity_events", "'created'", "actor", "resource", "timestamp")],
    "DeleteUser": [*_DELETED("identities"), entry("identity_events", "'deleted'", "actor", "resource", "timestamp")],
    "UpdateLoginProfile": [entry("password_changes", "actor", "resource", "timestamp")],
    "AssumeRole": _ASSUME, "AssignRole": _ASSUME,
    "CreateRole": [Change("reset", "roles", RESOURCE), *sets("roles", RESOURCE, created_by=ACTOR, created_at=TS)],
    "DeleteRole": _DELETED("roles"),
    "AttachRolePolicy": [Change("add", "roles", RESOURCE, "policies", "coalesce(policy_arn, resource, '')")],
    "DetachRolePolicy": [_POLICIES, Change("remove", "roles", RESOURCE, "policies", "coalesce(policy_arn, '')")],
    "PutRolePolicy": [Change("append", "inline_policies", RESOURCE, "policies", "coalesce(policy_document, '') || '|' || coalesce(actor, '') || '|' || coalesce(timestamp, '')")],
    "privilege_escalation": [Change("add", "privilege_state", _ESCALATING, "roles", _NEW_ROLE), Change("count", "privilege_state", _ESCALATING, "escalations"), *sets("privilege_state", _ESCALATING, last_escalation=TS), Change("first", "privilege_state", _ESCALATING, "first_escalation", TS)],
    "CreateAccessKey": _NEW_KEY, "CreateServiceAccountKey": _NEW_KEY, "DeleteAccessKey": _END_KEY, "DeleteServiceAccountKey": _END_KEY,
    "UpdateAccessKey": sets("access_keys", KEY_ID, active="CASE WHEN coalesce(status, 'Active') = 'Active' THEN 'true' ELSE 'false' END", status="coalesce(status, 'Active')"),
    "token_revocation": [Change("add", "revoked_tokens", "coalesce(token, '')", "revoked", "'true'")],
    "MFAAuth": sets("identities", ACTOR, mfa="'true'", last_mfa_ts=TS),
    "DeactivateMFADevice": [*sets("identities", TARGET, mfa="'false'"), entry("mfa_deactivations", "actor", "resource", "timestamp")],
    "EnableMFADevice": sets("identities", TARGET, mfa="'true'"),
    "resource_access": _ACCESS, "GetSecret": _ACCESS, "GetObject": _ACCESS, "SecretGet": _ACCESS,
    "GuardDutyFinding": _THREAT, "DefenderAlert": _THREAT, "SecurityHubFinding": _COMPLIANCE, "SCCFinding": _COMPLIANCE,
    "ExternalAccess": [Change("append", "external_access", RESOURCE, "principals", "coalesce(principal, 'unknown') || '|' || coalesce(timestamp, '')")],
}
CAPPED = ("role_assumption_log", "access_log")


def registered(*more: dict[str, list[Change]], aliases: dict[str, str] | None = None) -> dict[str, list[Change]]:
    """The built-in reducers with further ones, and other names for some."""
    out = dict(REDUCERS)
    for m in more:
        out |= m
    return out | {name: out[of] for name, of in (aliases or {}).items()}


def parsed(raw: DataFrame) -> DataFrame:
    """raw(seq, payload JSON) as (seq, fields as text).

    A payload is parsed once: the explosion of its one row keeps the parser from being copied into every expression over a field.
    """
    return raw.select("seq", F.explode(F.array(F.from_json("payload", ", ".join(f"{f} string" for f in FIELDS)))).alias("p")).select("seq", "p.*")


def changes(raw: DataFrame, reducers: dict[str, list[Change]] = REDUCERS) -> DataFrame:
    """(seq, ts, pos, op, kind, key, field, value): what each event changes, in its order. Members without a value are none; unknown types change nothing."""
    rules: dict[tuple[Change, ...], list[str]] = {}
    for name, listed in reducers.items():
        rules.setdefault(tuple(listed), []).append(name)
    found = F.lit(None)
    for listed, names in rules.items():
        row = F.array(*(F.struct(F.lit(c.op).alias("op"), F.lit(c.kind).alias("kind"), F.expr(c.key).alias("key"), F.lit(c.field).alias("field"), F.expr(c.value).cast("string").alias("value")) for c in listed))
        found = F.when(F.col("event_type").isin(*names), row).otherwise(found)
    rows = parsed(raw).withColumn("found", found).select("seq", F.col("timestamp").cast("double").alias("ts"), F.posexplode("found").alias("pos", "c"))
    return rows.select("seq", "ts", "pos", "c.*").where("value is not null")


SCHEMA = "kind string, key string, field string, element string, value string, seq_from long, ts_from double, seq_to long, ts_to double"


def intervals(raw: DataFrame, reducers: dict[str, list[Change]] = REDUCERS, log_cap: int = LOG_CAP) -> DataFrame:
    """The table of intervals of raw(seq, payload), in the shared folder; sequence numbers don't repeat."""
    all_ = cut(changes(raw, reducers))
    ordered = all_.where("op != 'log'").repartition("kind", "key").sortWithinPartitions("kind", "key", "seq", "pos")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        entity, there, before, event = None, False, False, None
        now: dict[str, tuple] = {}  # field: value, seq, ts
        members: dict[str, dict[str, tuple]] = {}  # field: member: value, seq, ts

        def closed(field: str, element: str | None, of: tuple, seq: int | None, ts: float | None) -> None:
            rows.append((*entity, field, element, *of, seq, ts))

        def all_closed(seq: int | None, ts: float | None) -> None:
            for f, of in now.items():
                closed(f, None, of, seq, ts)
            for f, held in members.items():
                for e, of in held.items():
                    closed(f, e, of, seq, ts)
            now.clear(), members.clear()

        def written() -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = [pa.string()] * 5 + [pa.int64(), pa.float64()] * 2
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return out

        for b in batches:
            for kind, key, seq, ts, op, field, value in zip(*(b.column(c).to_pylist() for c in ("kind", "key", "seq", "ts", "op", "field", "value")), strict=True):
                if (kind, key) != entity:
                    if entity:
                        all_closed(None, None)
                    entity, there, event = (kind, key), False, None
                if seq != event:
                    before, event = there, seq
                there = there or op != "exist"
                if op == "reset":
                    all_closed(seq, ts)
                elif op in ("set", "init", "exist", "first", "count"):
                    if op == "init" and before or op == "exist" and not there or op == "first" and field in now:
                        continue
                    if field in now:
                        closed(field, None, now[field], seq, ts)
                    now[field] = (str(int(now[field][0]) + 1 if field in now else 1) if op == "count" else value, seq, ts)
                elif op in ("add", "append"):
                    held = members.setdefault(field, {})
                    name = value if op == "add" else f"{seq}"
                    if name not in held:
                        held[name] = (value, seq, ts)
                        if len(held) > CAPS.get((kind, field), len(held)):
                            oldest = next(iter(held))
                            closed(field, oldest, held.pop(oldest), seq, ts)
                elif op == "remove" and value in members.get(field, {}):
                    closed(field, value, members[field].pop(value), seq, ts)
                if len(rows) >= 10_000:
                    yield written()
        if entity:
            all_closed(None, None)
        if rows:
            yield written()

    entities = ordered.mapInArrow(stream, SCHEMA)
    logs = all_.where("op = 'log'").select("kind", "key", "field", F.col("seq").cast("string").alias("element"), "value", F.col("seq").alias("seq_from"), F.col("ts").alias("ts_from"))
    free = logs.where(~F.col("kind").isin(*CAPPED)).select("*", F.lit(None).cast("long").alias("seq_to"), F.lit(None).cast("double").alias("ts_to"))
    out = entities.unionAll(free)
    for kind in CAPPED:
        placed = cut(ledger.numbered(logs.where(F.col("kind") == kind).withColumn("seq", F.col("seq_from"))).drop("seq"))
        later = placed.select((F.col("i") - log_cap).alias("i"), F.col("seq_from").alias("seq_to"), F.col("ts_from").alias("ts_to"))
        out = out.unionAll(placed.join(later, "i", "left").drop("i"))
    return cut(out)


def state_at(table: DataFrame, seq: int) -> DataFrame:
    """What holds after the event of that number."""
    return table.where((F.col("seq_from") <= seq) & (F.col("seq_to").isNull() | (F.col("seq_to") > seq)))


def state_at_time(table: DataFrame, ts: float) -> DataFrame:
    """What holds at a time (events at that time count); meant for ledgers whose times don't fall."""
    return table.where((F.col("ts_from") <= ts) & (F.col("seq_to").isNull() | (F.col("ts_to") > ts)))


def state_between(table: DataFrame, first: int, last: int) -> DataFrame:
    """All that begins or ends from one number to another: the versions of the state in between, as changes."""
    begins = table.where(F.col("seq_from").between(first, last)).select(F.col("seq_from").alias("seq"), F.lit("begins").alias("what"), "kind", "key", "field", "element", "value")
    return begins.unionAll(table.where(F.col("seq_to").between(first, last)).select("seq_to", F.lit("ends"), "kind", "key", "field", "element", "value"))


def rollback(table: DataFrame, seq: int) -> DataFrame:
    """The table as it was after the event of that number: later intervals go, those that ended later are open again."""
    later = F.col("seq_to") > seq
    return table.where(F.col("seq_from") <= seq).withColumns({"seq_to": F.when(~later, F.col("seq_to")), "ts_to": F.when(~later, F.col("ts_to"))})


def diff(table: DataFrame, first: int, last: int) -> DataFrame:
    """Fields and members whose value differs between two numbers: (kind, key, field, element, before, after)."""
    key = ("kind", "key", "field")
    a, b = (state_at(table, n).select(*key, F.coalesce("element", F.lit("")).alias("element"), F.col("value").alias(name)) for n, name in ((first, "before"), (last, "after")))
    return a.join(b, [*key, "element"], "full").where("not (before <=> after)")


def raw_events(ev: DataFrame) -> DataFrame:
    """(seq, payload): the test events as raw JSON of all 32 types; the fields are made up from the event's numbers."""
    return ev.select(F.col("event_id").alias("seq"), F.to_json(F.struct(*(F.expr(x).alias(n) for n, x in _MADE.items()))).alias("payload"))


_TYPE = "CASE (event_id * 7 + k) % 32 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(REDUCERS)) + " END"
#: The payload's fields, as SQL over event_id, us, actor, k that Spark and DuckDB read alike.
_MADE = {
    "event_id": "concat('e', event_id)", "event_type": _TYPE, "actor": "CASE WHEN event_id % 29 > 0 THEN concat('u', actor % 40) END", "timestamp": "CAST(CAST(floor(us / 1000000) AS BIGINT) AS VARCHAR(20))",
    "resource": f"CASE WHEN {_TYPE} LIKE '%User' OR {_TYPE} LIKE '%MFA%' OR {_TYPE} LIKE '%Profile' THEN concat('u', k % 40) WHEN {_TYPE} LIKE '%Role%' THEN concat('role', k % 6) WHEN {_TYPE} LIKE '%Key' THEN concat('key', k % 9) ELSE concat('res', k % 30) END",
    "ip": "CASE WHEN event_id % 13 > 0 THEN concat('10.0.0.', event_id % 30) END", "region": "concat('r', k % 4)", "policy_arn": "CASE WHEN event_id % 5 > 0 THEN concat('p', event_id % 7) END", "access_key_id": "CASE WHEN event_id % 3 > 0 THEN concat('k', k % 11) END",
    "status": "CASE WHEN event_id % 2 = 0 THEN 'Active' WHEN event_id % 3 > 0 THEN 'Inactive' END", "token": "concat('t', k % 50)", "new_role": "CASE WHEN event_id % 4 > 0 THEN concat('role', k % 6) END", "principal": "concat('x', k % 5)", "severity": "CASE WHEN event_id % 7 > 0 THEN 'high' END",
    "action": "action",
}


def _table(s, d):
    return intervals(cut(raw_events(events(s, d))))


def _half(s, d) -> int:
    return events(s, d).agg(F.max("event_id")).first()[0] // 2


QUERIES = {
    "l6_intervals": _table,
    "l7_state_at": lambda s, d: state_at(_table(s, d), _half(s, d)).select("kind", "key", "field", "element", "value"),
    "l7_state_between": lambda s, d: state_between(_table(s, d), _half(s, d), _half(s, d) + 100),
    "l7_rollback": lambda s, d: rollback(_table(s, d), _half(s, d)),
    "l7_diff": lambda s, d: diff(_table(s, d), _half(s, d), 2 * _half(s, d)),
}


def _sql_changes() -> str:
    rules: dict[tuple[Change, ...], list[str]] = {}
    for name, listed in REDUCERS.items():
        rules.setdefault(tuple(listed), []).append(name)
    return " UNION ALL ".join(
        f"SELECT seq, CAST(timestamp AS DOUBLE) AS ts, {pos} AS pos, '{c.op}' AS op, '{c.kind}' AS kind, {c.key} AS key, '{c.field}' AS field, {c.value} AS value FROM raw WHERE event_type IN ({', '.join(repr(n) for n in names)})"
        for listed, names in rules.items() for pos, c in enumerate(listed)
    )


_ENTITY, _ORDER = "PARTITION BY kind, key", "ORDER BY seq, pos"
_IV = EV + ", raw AS (SELECT event_id AS seq, " + ", ".join(f"{x} AS {n}" for n, x in _MADE.items() if n != "event_id") + ", " + ", ".join(f"NULL::VARCHAR AS {f}" for f in FIELDS if f not in _MADE) + ", concat('e', event_id) AS event_id FROM ev), ch AS (SELECT * FROM (" + _sql_changes() + f""") WHERE value IS NOT NULL),
 ex AS (SELECT *, count(*) FILTER (op <> 'exist') OVER ({_ENTITY} ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS existed FROM ch WHERE op <> 'log'),
 ef AS (SELECT *, sum((op = 'reset')::INT) OVER ({_ENTITY} {_ORDER}) AS life FROM ex WHERE op NOT IN ('exist', 'init') OR existed = (op = 'exist')),
 nr AS (SELECT *, min(CASE WHEN op = 'reset' THEN {{"s": seq, "t": ts}} END) OVER ({_ENTITY} {_ORDER} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM ef),
 sc AS (SELECT *, lead({{"s": seq, "t": ts}}) OVER w AS nx, row_number() OVER w AS rn, count(*) FILTER (op = 'count') OVER w AS n FROM nr WHERE op IN ('set', 'init', 'exist', 'count') OR (op = 'first') WINDOW w AS (PARTITION BY kind, key, field, life {_ORDER})),
 sf AS (SELECT *, CASE WHEN op = 'first' THEN r ELSE coalesce(nx, r) END AS e FROM sc WHERE op <> 'first' OR rn = 1),
 me AS (SELECT *, lag(op) OVER w AS bf, first_value(CASE WHEN op = 'remove' THEN {{"s": seq, "t": ts}} END IGNORE NULLS) OVER (PARTITION BY kind, key, field, life, value {_ORDER} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rm FROM nr WHERE op IN ('add', 'remove') WINDOW w AS (PARTITION BY kind, key, field, life, value {_ORDER})),
 iv AS (SELECT kind, key, field, NULL::VARCHAR AS element, CASE WHEN op = 'count' THEN n::VARCHAR ELSE value END AS value, seq AS seq_from, ts AS ts_from, e.s AS seq_to, e.t AS ts_to FROM sf
  UNION ALL SELECT kind, key, field, value, value, seq, ts, coalesce(rm, r).s, coalesce(rm, r).t FROM me WHERE op = 'add' AND bf IS DISTINCT FROM 'add'
  UNION ALL SELECT kind, key, field, seq::VARCHAR, value, seq, ts, r.s, r.t FROM nr WHERE op = 'append'
  UNION ALL SELECT kind, key, field, seq::VARCHAR, value, seq, ts, CASE WHEN kind IN {CAPPED} THEN lead(seq, {LOG_CAP}) OVER w END, CASE WHEN kind IN {CAPPED} THEN lead(ts, {LOG_CAP}) OVER w END FROM ch WHERE op = 'log' WINDOW w AS (PARTITION BY kind ORDER BY seq)), hf AS (SELECT max(event_id) // 2 AS h FROM ev)"""
_AT = lambda n: f"SELECT kind, key, field, element, value FROM iv, hf WHERE seq_from <= {n} AND (seq_to IS NULL OR seq_to > {n})"
ORACLE = {
    "l6_intervals": _IV + " SELECT * FROM iv",
    "l7_state_at": _IV + " " + _AT("h"),
    "l7_state_between": _IV + " SELECT seq_from AS seq, 'begins' AS what, kind, key, field, element, value FROM iv, hf WHERE seq_from BETWEEN h AND h + 100 UNION ALL SELECT seq_to, 'ends', kind, key, field, element, value FROM iv, hf WHERE seq_to BETWEEN h AND h + 100",
    "l7_rollback": _IV + " SELECT kind, key, field, element, value, seq_from, ts_from, CASE WHEN seq_to <= h THEN seq_to END AS seq_to, CASE WHEN seq_to <= h THEN ts_to END AS ts_to FROM iv, hf WHERE seq_from <= h",
    "l7_diff": _IV + f", a AS ({_AT('h')}), b AS ({_AT('2 * h')}) SELECT kind, key, field, element, a.value AS before, b.value AS after FROM (SELECT kind, key, field, coalesce(element, '') AS element, value FROM a) a FULL JOIN (SELECT kind, key, field, coalesce(element, '') AS element, value FROM b) b USING (kind, key, field, element) WHERE a.value IS DISTINCT FROM b.value",
}
