"""Hash chains, proofs, signed heads, replay, checkpoints, snapshots and retention over ledgers of events.

A chain's next hash needs the one before, so a chain is written by one task, in order, which keeps only the last hash; there is one chain a tenant (actor), and
checking a chain is parallel. Merkle levels are groupings that halve the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brinewatch.functions.prefix import sums_before
from brinewatch.operators import ledger
from brinewatch.sources.tables import DAY, EV, cut, events

GENESIS = ledger.GENESIS


def chained(ev: DataFrame) -> DataFrame:
    """Records (actor, seq from 1, event_id, us, action, resource, content, prev_hash, record_hash) appended to their actor's chain in the order of time.

    A record's hash is that of its canonical text and of the hash before.
    """
    ordered = ev.select("actor", "us", "event_id", "action", "resource").repartition("actor").sortWithinPartitions("actor", "us", "event_id")

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        actor, seq, last = None, 0, GENESIS
        for b in batches:
            rows: dict[str, list] = {n: [] for n in ("seq", "content", "prev_hash", "record_hash")}
            for a, e, act, res in zip(*(b.column(c).to_pylist() for c in ("actor", "event_id", "action", "resource")), strict=True):
                if a != actor:
                    actor, seq, last = a, 0, GENESIS
                seq += 1
                content = f'{{"action":"{act}","actor":{a},"event_id":{e},"resource":"{res}","seq":{seq}}}'
                own = hashlib.sha256(f"{content}{last}".encode()).hexdigest()
                for n, v in zip(rows, (seq, content, last, own), strict=True):
                    rows[n].append(v)
                last = own
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows["seq"], pa.int64()), *(pa.array(rows[n], pa.string()) for n in ("content", "prev_hash", "record_hash"))], [*b.schema.names, *rows])

    schema = "actor long, us long, event_id long, action string, resource string, seq long, content string, prev_hash string, record_hash string"
    return ordered.mapInArrow(append, schema)


def damaged(chain: DataFrame) -> DataFrame:
    """A chain with records taken out and altered at fixed places, so that there is something to find."""
    return chain.where("event_id % 61 != 7").withColumn("content", F.when(F.col("event_id") % 53 == 11, F.concat("content", F.lit(" "))).otherwise(F.col("content")))


def chain_errors(chain: DataFrame) -> DataFrame:
    """Gaps in the sequence, links that don't fit, hashes that don't fit and a wrong first link, by record."""
    w = W.partitionBy("actor").orderBy("seq")
    x = chain.withColumns({"before": F.lag("seq").over(w), "link": F.lag("record_hash").over(w)})
    found = F.array_compact(F.array(
        F.when(F.col("seq") != F.coalesce("before", F.lit(0)) + 1, F.lit("SEQUENCE_GAP")), F.when(F.col("prev_hash") != F.coalesce("link", F.lit(GENESIS)), F.lit("CHAIN_BROKEN")),
        F.when(F.sha2(F.concat("content", "prev_hash"), 256) != F.col("record_hash"), F.lit("HASH_MISMATCH")),
    ))
    return x.select("actor", "seq", F.explode(found).alias("error"))


def leaves(ev: DataFrame) -> DataFrame:
    """(i, h): every event's place in the order of ids, and its hash."""
    h = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "action"), 256)
    return cut(ledger.numbered(ev.select(F.col("event_id").alias("seq"), h.alias("h")), "h").select("i", "h"))


def inclusion_proof(tree: DataFrame, at: int) -> DataFrame:
    """(level, side, hash): the neighbours with which leaf `at` hashes up to the root; a last odd one is its own neighbour. One row a level."""
    level, n, k = tree, tree.count(), 0
    if not 0 <= at < n:
        raise ValueError("no such leaf")
    proof = tree.where("false").select(F.lit(0).cast("bigint").alias("level"), F.lit("").alias("side"), F.col("h").alias("hash"))
    while n > 1:
        other = at ^ 1 if at ^ 1 < n else at
        proof = proof.unionAll(level.where(F.col("i") == other).select(F.lit(k).cast("bigint"), F.lit("left" if other < at else "right"), "h"))
        pair = level.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.min_by("h", "i").alias("l"), F.max_by("h", "i").alias("r"))
        level = cut(pair.select("i", F.sha2(F.concat("l", "r"), 256).alias("h")))
        at, n, k = at // 2, -(-n // 2), k + 1
    return proof


def proves(proof: list, leaf: str, root: str) -> bool:
    """Whether a proof's rows lead from a leaf's hash to the root."""
    for r in sorted(proof, key=lambda r: r.level):
        pair = (r.hash + leaf) if r.side == "left" else (leaf + r.hash)
        leaf = hashlib.sha256(pair.encode()).hexdigest()
    return leaf == root


def hmac_sha256(key: bytes, text: Column) -> Column:
    """HMAC-SHA-256 as hex, by two digests."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in key))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), F.encode(text, "UTF-8")), 256))), 256)


KEY = b"test-key"


def audit_query(log: DataFrame, actor: int | None = None, action: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """Records by any of actor, action and time (both ends count)."""
    for value, holds in ((actor, F.col("actor") == F.lit(actor)), (action, F.col("action") == F.lit(action)), (since, F.col("us") >= F.lit(since)), (until, F.col("us") <= F.lit(until))):
        log = log if value is None else log.where(holds)
    return log


def audit_page(log: DataFrame, after: int, limit: int) -> DataFrame:
    """The next page of records behind a cursor (a sequence number), in order."""
    return log.where(F.col("event_id") > after).orderBy("event_id").limit(limit)


def replayed(log: DataFrame, after: int = -1, until: int | None = None) -> DataFrame:
    """State by actor from a log in any order with repeats: sequence numbers up to `after` are dropped, of repeats one counts; a digest of the state."""
    x = log.where(F.col("event_id") > after)
    x = (x if until is None else x.where(F.col("event_id") <= until)).dropDuplicates(["event_id"])
    a = x.groupBy("actor").agg(F.count("*").alias("n"), F.max_by("action", "event_id").alias("last_action"), F.max("event_id").alias("last_seq"), F.countDistinct("resource").alias("resources"))
    return a.withColumn("state_hash", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("actor", "n", "last_action", "last_seq", "resources"))), 256))


def checkpoints(log: DataFrame, every: int = 200) -> DataFrame:
    """(seq, n, total): running state at every so manyth sequence number, as a store would hold it, from sums by step."""
    step = F.floor(F.col("event_id") / every)
    s = log.groupBy(step.alias("step")).agg(F.count("*").alias("own"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("own_cents"))  # one row a checkpoint
    s = sums_before(s, "step", {"n": "own", "cents": "own_cents"})
    return s.select(((F.col("step") + 1) * every - 1).alias("seq"), (F.col("n") + F.col("own")).alias("n"), (F.col("cents") + F.col("own_cents")).alias("cents"))


def checkpoint_errors(log: DataFrame, stored: DataFrame, every: int = 200) -> DataFrame:
    """Stored checkpoints that a replay contradicts or lacks, and what it says."""
    a, b = stored.select("seq", F.col("n").alias("stored_n"), F.col("cents").alias("stored_cents")), checkpoints(log, every)
    return a.join(b, "seq", "full").where(~F.col("n").eqNullSafe(F.col("stored_n")) | ~F.col("cents").eqNullSafe(F.col("stored_cents"))).select("seq", "stored_n", "n", "stored_cents", "cents")


def snapshots(log: DataFrame, keep: int = 3) -> DataFrame:
    """A snapshot of each actor's state every five days with the digest of its text, pruned to the newest keep."""
    x = log.withColumn("period", F.floor(F.col("us") / (5 * DAY)))
    s = x.groupBy("actor", "period").agg(F.count("*").alias("m"), F.max("event_id").alias("last_seq"))
    w = W.partitionBy("actor").orderBy("period")
    s = s.withColumn("n", F.sum("m").over(w)).withColumn("state", F.concat(F.lit('{"last_seq":'), F.col("last_seq").cast("string"), F.lit(',"n":'), F.col("n").cast("string"), F.lit("}")))
    s = s.withColumn("place", F.row_number().over(W.partitionBy("actor").orderBy(F.desc("period"))))
    return s.where(F.col("place") <= keep).select("actor", "period", "state", F.sha2("state", 256).alias("digest"))


def snapshot_errors(stored: DataFrame) -> DataFrame:
    """Snapshots whose digest doesn't fit their state."""
    return stored.where(F.sha2("state", 256) != F.col("digest")).select("actor", "period")


#: Days that records are kept, by action.
KEPT_DAYS = {"view": 10, "click": 15, "purchase": 30, "signup": 30, "error": 20}


def retention(log: DataFrame, erased: DataFrame) -> DataFrame:
    """What a retention run does with each record: erased (its actor asked for it), expired (older than its action is kept), or kept; counted by action."""
    now = log.agg(F.max("us").alias("now"))
    days = F.create_map(*[F.lit(x) for pair in KEPT_DAYS.items() for x in pair])[F.col("action")]
    x = log.crossJoin(F.broadcast(now)).join(erased.select("actor", F.lit(True).alias("asked")), "actor", "left")
    fate = F.when(F.coalesce("asked", F.lit(False)), "erased").when(F.col("us") < F.col("now") - days * DAY, "expired").otherwise("kept")
    return x.groupBy("action", fate.alias("fate")).agg(F.count("*").alias("n"))


def _e(f, *a):
    return lambda s, d: f(events(s, d), *a)


def _proof(s, d):
    tree = leaves(events(s, d))
    return inclusion_proof(tree, tree.count() // 3)


def _checkpoints(s, d):
    ev = events(s, d)
    stored = checkpoints(ev).withColumn("n", F.when(F.col("seq") % 1000 == 599, F.col("n") + 1).otherwise(F.col("n"))).where("seq % 1000 != 799")
    return checkpoint_errors(ev, stored)


def _snapshot_errors(s, d):
    stored = snapshots(events(s, d)).withColumn("state", F.when(F.col("actor") % 9 == 4, F.replace("state", F.lit('"n":'), F.lit('"n":1'))).otherwise(F.col("state")))
    return snapshot_errors(stored)


QUERIES = {
    "l1_chained": lambda s, d: chained(events(s, d)).select("actor", "seq", "event_id", "prev_hash", "record_hash"),
    "l2_chain_errors": lambda s, d: chain_errors(damaged(chained(events(s, d)))),
    "l3_merkle_root": lambda s, d: ledger.merkle_root(leaves(events(s, d))),
    "l3_inclusion_proof": _proof,
    "l5_audit_query": lambda s, d: audit_query(events(s, d), action="error", since=1704844800000000, until=1705708800000000).select("event_id", "actor", "resource"),
    "s9_page": lambda s, d: audit_page(events(s, d), 100, 50).select("event_id", "actor", "action"),
    "l8_replayed": lambda s, d: replayed(events(s, d).unionAll(events(s, d).where("event_id % 5 = 0")), 99), "l12_replayed_range": lambda s, d: replayed(events(s, d), 199, 700),
    "l10_checkpoint_errors": _checkpoints, "s13_snapshots": _e(snapshots), "s13_snapshot_errors": _snapshot_errors,
    "l15_retention": lambda s, d: retention(events(s, d), events(s, d).where("action = 'signup' and value > 150").select("actor").distinct()),
}
_CHAIN = EV.replace("WITH ev", "WITH RECURSIVE ev") + f""", o AS (SELECT actor, event_id, action, resource, row_number() OVER (PARTITION BY actor ORDER BY us, event_id) AS seq FROM ev), t AS (SELECT *, '{{"action":"' || action || '","actor":' || actor || ',"event_id":' || event_id || ',"resource":"' || resource || '","seq":' || seq || '}}' AS content FROM o),
 ch AS (SELECT actor, seq, event_id, content, '{GENESIS}' AS prev_hash, sha256(content || '{GENESIS}') AS record_hash FROM t WHERE seq = 1 UNION ALL SELECT t.actor, t.seq, t.event_id, t.content, ch.record_hash, sha256(t.content || ch.record_hash) FROM ch JOIN t ON t.actor = ch.actor AND t.seq = ch.seq + 1)"""
_TREE = EV + ", n0 AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, sha256(event_id || '|' || action) AS h FROM ev)" + "".join(f", n{k + 1} AS MATERIALIZED (SELECT i // 2 AS i, CASE WHEN (SELECT count(*) FROM n{k}) = 1 THEN min(h) ELSE sha256(min_by(h, i) || max_by(h, i)) END AS h FROM n{k} GROUP BY 1)" for k in range(22))
_STATE = "count(*) AS n, max_by(action, event_id) AS last_action, max(event_id) AS last_seq, count(DISTINCT resource) AS resources"
_HASHED = "SELECT *, sha256(actor || '|' || n || '|' || last_action || '|' || last_seq || '|' || resources) AS state_hash FROM a"
_CHECK = EV + ", s AS (SELECT event_id // 200 AS step, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM ev GROUP BY 1), c AS (SELECT (step + 1) * 200 - 1 AS seq, CAST(sum(n) OVER (ORDER BY step) AS BIGINT) AS n, CAST(sum(cents) OVER (ORDER BY step) AS BIGINT) AS cents FROM s)"
_SNAP = EV + f""", x AS (SELECT actor, us // {5 * DAY} AS period, count(*) AS m, max(event_id) AS last_seq FROM ev GROUP BY ALL), y AS (SELECT *, CAST(sum(m) OVER (PARTITION BY actor ORDER BY period) AS BIGINT) AS n, row_number() OVER (PARTITION BY actor ORDER BY period DESC) AS place FROM x),
 z AS (SELECT actor, period, '{{"last_seq":' || last_seq || ',"n":' || n || '}}' AS state FROM y WHERE place <= 3)"""
ORACLE = {
    "l1_chained": _CHAIN + " SELECT actor, seq, event_id, prev_hash, record_hash FROM ch",
    "l2_chain_errors": _CHAIN + f""", dm AS (SELECT * REPLACE (CASE WHEN event_id % 53 = 11 THEN content || ' ' ELSE content END AS content) FROM ch WHERE event_id % 61 <> 7), lk AS (SELECT *, lag(seq) OVER (PARTITION BY actor ORDER BY seq) AS b, lag(record_hash) OVER (PARTITION BY actor ORDER BY seq) AS l FROM dm)
 SELECT actor, seq, 'SEQUENCE_GAP' AS error FROM lk WHERE seq <> coalesce(b, 0) + 1 UNION ALL SELECT actor, seq, 'CHAIN_BROKEN' FROM lk WHERE prev_hash <> coalesce(l, '{GENESIS}') UNION ALL SELECT actor, seq, 'HASH_MISMATCH' FROM lk WHERE sha256(content || prev_hash) <> record_hash""",
    "l3_merkle_root": _TREE + " SELECT h AS root FROM n22",
    "l3_inclusion_proof": _TREE + ", cn AS (SELECT count(*) AS n, count(*) // 3 AS pos FROM n0)" + " UNION ALL ".join(
        ("" if k else " ") + f"SELECT {k}::BIGINT AS level, CASE WHEN i < pos // {1 << k} THEN 'left' ELSE 'right' END AS side, h AS hash FROM n{k}, cn WHERE (SELECT count(*) FROM n{k}) > 1 AND i = CASE WHEN xor(pos // {1 << k}, 1) < (SELECT count(*) FROM n{k}) THEN xor(pos // {1 << k}, 1) ELSE pos // {1 << k} END" for k in range(22)),
    "l5_audit_query": EV + " SELECT event_id, actor, resource FROM ev WHERE action = 'error' AND us BETWEEN 1704844800000000 AND 1705708800000000",
    "s9_page": EV + " SELECT event_id, actor, action FROM ev WHERE event_id > 100 ORDER BY event_id LIMIT 50",
    "l8_replayed": EV + f", a AS (SELECT actor, {_STATE} FROM ev WHERE event_id > 99 GROUP BY actor) " + _HASHED,
    "l12_replayed_range": EV + f", a AS (SELECT actor, {_STATE} FROM ev WHERE event_id > 199 AND event_id <= 700 GROUP BY actor) " + _HASHED,
    "l10_checkpoint_errors": _CHECK + """, st AS (SELECT seq, CASE WHEN seq % 1000 = 599 THEN n + 1 ELSE n END AS stored_n, cents AS stored_cents FROM c WHERE seq % 1000 <> 799) SELECT seq, stored_n, n, stored_cents, cents FROM st FULL JOIN c USING (seq) WHERE n IS DISTINCT FROM stored_n OR cents IS DISTINCT FROM stored_cents""",
    "s13_snapshots": _SNAP + " SELECT actor, period, state, sha256(state) AS digest FROM z",
    "s13_snapshot_errors": _SNAP + " SELECT actor, period FROM z WHERE actor % 9 = 4",
    "l15_retention": EV + ", w AS (SELECT *, max(us) OVER () AS now, actor IN (SELECT actor FROM ev WHERE action = 'signup' AND value > 150) AS asked, CASE action " + " ".join(f"WHEN '{a}' THEN {n}" for a, n in KEPT_DAYS.items()) + f" END AS days FROM ev) SELECT action, CASE WHEN asked THEN 'erased' WHEN us < now - days * {DAY} THEN 'expired' ELSE 'kept' END AS fate, count(*) AS n FROM w GROUP BY ALL",
}
