"""A Merkle log kept as a table of its perfect subtrees, so that appending, proving and signing touch few rows.

A node (level k, place i) is the hash over leaves i * 2**k up to (i + 1) * 2**k; only nodes whose leaves are all there are stored, and those never change. The root of the
first m leaves follows from at most log2(m) of them: where a level has an odd number of nodes its last one hashes with itself. The table is partitioned by level and by runs of
places, so a look-up reads the few files that hold what it asks for.

* Appending reads, on every eighth level, the up to 255 nodes left of the new ones, and writes new nodes only.
* An inclusion proof is a leaf's sibling on each level.
* A consistency proof for an old size m of a log of n: the nodes that m leaves split into, and those that leaves m to n split into. From the first follows the old root, from both the new one: a
  log that was rewritten below m can't give both.
* Signed heads: one a day, over the root of that day's size, each with the signature before.

Rows equal in (level, i, h) may be stored twice, after an append that was run again; look-ups take one.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from brinewatch.operators import records
from brinewatch.sources.tables import DAY, EV, cut, events, shared_dir

STEP = 8
RUN = 1 << 20
SCHEMA = "i long, h string, level int, part long"


def pairs(hashes: Column) -> Column:
    """The hashes of neighbours, without an odd last one."""
    both = F.transform(hashes, lambda h, j: F.when(j % 2 == 0, F.sha2(F.concat(h, F.get(hashes, j + 1)), 256)))  # null without a right neighbour
    return F.array_compact(both)


class Log:
    """The stored nodes of a log and its size."""

    def __init__(self, spark: SparkSession, path: str, size: int = 0) -> None:
        self.spark, self.path, self.size = spark, path, size

    def nodes(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path) if self.size else self.spark.createDataFrame([], SCHEMA)

    def append(self, leaves: DataFrame) -> Log:
        """The log with leaves (i from 0, h) behind those it has. Eight levels are one grouping, of 256 nodes a row."""
        old, n = self.size, leaves.count()
        level, new = 0, leaves.select((F.col("i") + old).alias("i"), "h")
        while True:
            first = old >> level  # the first place on this level that isn't stored
            left = self.nodes().where((F.col("level") == level) & (F.col("part") == first // RUN) & F.col("i").between(first // 256 * 256, first - 1)).select("i", "h").distinct()
            rows = new.unionAll(left).groupBy(F.expr(f"i div {256}").alias("g")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("x"))
            lists = F.aggregate(F.sequence(F.lit(1), F.lit(STEP)), F.array(F.transform("x", lambda x: x.h)), lambda all_, _: F.concat(all_, F.array(pairs(F.element_at(all_, -1)))))
            rows = cut(rows.select("g", lists.alias("lists")))
            made = rows.select("g", F.posexplode(F.slice("lists", 1, STEP)).alias("k", "h")).select((F.col("k") + level).alias("level"), F.expr("g * shiftright(256, k)").alias("at"), F.posexplode("h").alias("p", "h"))
            made = made.select((F.col("at") + F.col("p")).alias("i"), "h", "level").where(F.expr(f"i >= shiftright({old}L, level)"))
            made.withColumn("part", F.expr(f"i div {RUN}")).write.mode("append").partitionBy("level", "part").parquet(self.path)
            level += STEP
            if (old + n) >> level <= old >> level:
                break
            new = rows.select(F.col("g").alias("i"), F.get(F.get("lists", F.lit(STEP)), F.lit(0)).alias("h")).where(F.col("h").isNotNull() & (F.col("i") >= old >> level))
        return Log(self.spark, self.path, old + n)

    def at(self, asked: DataFrame) -> DataFrame:
        """asked(level, i, ...) with each node's hash. Joined by partition columns too, so only files that hold something are read."""
        asked = asked.withColumn("level", F.col("level").cast("int")).withColumn("part", F.expr(f"i div {RUN}"))
        return self.nodes().dropDuplicates(["level", "part", "i"]).join(asked, ["level", "part", "i"]).drop("part")

    def roots(self, sizes: DataFrame) -> DataFrame:
        """sizes(size) with the root of so many first leaves (size at least 1). A size needs its last leaf and the left neighbours of the way up."""
        level = F.explode(F.expr("sequence(0, cast(greatest(ceil(log2(size)), 0) as int))"))
        ways = sizes.select("size").distinct().withColumn("level", level).withColumn("count", F.expr("shiftright(size - 1, level) + 1"))
        top = F.expr("size = shiftleft(shiftright(size, level), level)")  # the last node of the level is perfect
        last = ways.where(top).groupBy("size").agg(F.max("level").alias("level")).withColumn("i", F.expr("shiftright(size, level) - 1"))
        lefts = ways.where("count % 2 = 0").withColumn("i", F.col("count") - 2)
        asked = last.select("size", "level", "i", F.lit(True).alias("start")).unionAll(lefts.select("size", "level", "i", F.lit(False)))
        got = self.at(asked).groupBy("size").agg(F.min(F.when(F.col("start"), F.struct("level", "h"))).alias("first"), F.map_from_entries(F.collect_list(F.when(~F.col("start"), F.struct("level", "h")))).alias("left"))
        up = F.expr("filter(sequence(0, 62), k -> k >= first.level and shiftright(size - 1, k) > 0)")

        def climb(h: Column, k: Column) -> Column:
            even = F.try_element_at("left", k)
            return F.sha2(F.concat(F.coalesce(even, h), h), 256)

        return got.withColumn("_up", up).select("size", F.aggregate("_up", F.col("first.h"), climb).alias("root"))

    def consistency(self, sizes: DataFrame) -> DataFrame:
        """(old_size, level, i, h): for each of sizes(size) the proof that the log begins with what it was at that size."""
        n = self.size
        levels = sizes.select(F.col("size").alias("old_size")).distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(n.bit_length()))))
        lo, hi = F.expr("shiftright(old_size + shiftleft(1L, level) - 1, level)"), F.expr(f"shiftright({n}L, level)")
        places = F.array(
            F.when(F.expr("shiftright(old_size, level) % 2 = 1"), F.expr("shiftright(old_size, level) - 1")),
            F.when((lo % 2 == 1) & (lo < hi), lo), F.when((hi % 2 == 1) & (lo < hi), hi - 1),
        )
        asked = levels.select("old_size", "level", F.explode(F.array_distinct(F.array_compact(places))).alias("i"))
        return self.at(asked).select("old_size", F.col("level").cast("bigint").alias("level"), "i", "h")


def root_of(proof: dict[tuple[int, int], str], n: int) -> str | None:
    """The root of n leaves from nodes (level, i) that cover them; None if they don't."""

    def value(level: int, i: int) -> str | None:
        if (level, i) in proof:
            return proof[level, i]
        if not level:
            return None
        left = value(level - 1, 2 * i)
        right = value(level - 1, 2 * i + 1) if (2 * i + 1) << (level - 1) < n else left
        return hashlib.sha256((left + right).encode()).hexdigest() if left and right else None

    return value((n - 1).bit_length(), 0)


def consistent(proof: dict[tuple[int, int], str], old: int, old_root: str, new: int, new_root: str) -> bool:
    """Whether a consistency proof leads to both roots."""
    before = {k: h for k, h in proof.items() if (k[1] + 1) << k[0] <= old}
    return root_of(before, old) == old_root and root_of(proof, new) == new_root


def stored(ev: DataFrame) -> Log:
    """The log of all events in the order of ids, appended in two parts."""
    spark, tree = ev.sparkSession, records.leaves(ev)
    n = tree.count()
    log = Log(spark, f"{shared_dir(spark)}/merkle-{uuid.uuid4().hex}")
    if n:
        log = log.append(tree.where(F.col("i") < n // 3))
        log = log.append(tree.where(F.col("i") >= n // 3).select((F.col("i") - n // 3).alias("i"), "h"))
    return log


def day_sizes(ev: DataFrame) -> DataFrame:
    """(day, size): how many records there are by the end of each day that has some."""
    days = ev.groupBy(F.floor(F.col("us") / DAY).alias("day")).agg(F.count("*").alias("n"))  # a row a day
    return days.select("day", F.sum("n").over(W.orderBy("day")).alias("size"))


KEY = records.KEY


def payload(root: str, size: int, timestamp: float, previous: str | None) -> bytes:
    """What a head's signature covers."""
    return json.dumps({"root": root, "tree_size": size, "timestamp": timestamp, "prev_signature": previous}, sort_keys=True).encode()


def signed(heads: DataFrame, key: bytes = KEY) -> DataFrame:
    """heads(day, tree_size, root) with previous and signature. Each signature covers the one before: one stream over a row a day, which holds the last signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            before, own = [], []
            for day, size, root in zip(*(b.column(c).to_pylist() for c in ("day", "tree_size", "root")), strict=True):
                before.append(last)
                last = hmac.new(key, payload(root, size, (day + 1) * 86400.0, last), hashlib.sha256).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("day", "tree_size", "root")), pa.array(before, pa.string()), pa.array(own, pa.string())], ["day", "tree_size", "root", "previous", "signature"])

    ordered = heads.select(F.col("day").cast("bigint").alias("day"), F.col("tree_size").cast("bigint").alias("tree_size"), "root").repartition(1).sortWithinPartitions("day")
    return ordered.mapInArrow(sign, "day long, tree_size long, root string, previous string, signature string")


def tree_heads(ev: DataFrame) -> DataFrame:
    """A signed head a day over the root of all records there are by then (records in the order of ids)."""
    log, days = stored(ev), cut(day_sizes(ev))
    heads = days.join(log.roots(days), "size")
    return signed(heads.select("day", F.col("size").alias("tree_size"), "root"))


def head_errors(heads: DataFrame, now: float, skew: float = 300.0, key: bytes = KEY) -> DataFrame:
    """(day, error): signatures that don't fit, links that aren't the signature before, sizes that shrink, heads from the future. A row a day."""
    w = W.orderBy("day")
    at = (F.col("day") + 1) * 86400
    text = F.concat(
        F.lit('{"prev_signature": '), F.coalesce(F.concat(F.lit('"'), "previous", F.lit('"')), F.lit("null")), F.lit(', "root": "'), "root",
        F.lit('", "timestamp": '), at.cast("string"), F.lit('.0, "tree_size": '), F.col("tree_size").cast("string"), F.lit("}"),
    )
    found = F.array_compact(F.array(
        F.when(records.hmac_sha256(key, text) != F.col("signature"), F.lit("BAD_SIGNATURE")), F.when(~F.col("previous").eqNullSafe(F.lag("signature").over(w)), F.lit("BROKEN_LINK")),
        F.when(F.col("tree_size") < F.lag("tree_size").over(w), F.lit("SHRUNK")), F.when(at > now + skew, F.lit("FUTURE")),
    ))
    return heads.withColumn("_found", found).select("day", F.explode("_found").alias("error"))


def _proofs(s: SparkSession, d: str) -> DataFrame:
    ev = events(s, d)
    return stored(ev).consistency(day_sizes(ev))


def _roots(s: SparkSession, d: str) -> DataFrame:
    ev = events(s, d)
    return stored(ev).roots(day_sizes(ev))


def _inclusion(s: SparkSession, d: str) -> DataFrame:
    """The left and right neighbours of a third of the way's leaf, as far as they are perfect."""
    ev = events(s, d)
    log = stored(ev)
    at = log.size // 3
    asked = s.createDataFrame([(k, (at >> k) ^ 1) for k in range(log.size.bit_length())], "level int, i long")
    return log.at(asked).select(F.col("level").cast("bigint").alias("level"), "i", "h")


def _bad_heads(s: SparkSession, d: str) -> DataFrame:
    heads = cut(tree_heads(events(s, d)))
    bad = heads.withColumn("tree_size", F.when(F.col("day") % 7 == 3, F.col("tree_size") - 400).otherwise(F.col("tree_size")))
    return head_errors(bad.where("day % 11 != 5"), 19_750 * 86400.0)


QUERIES = {"l3_consistency_proof": _proofs, "l3_roots": _roots, "l3_siblings": _inclusion, "l4_tree_heads": lambda s, d: tree_heads(events(s, d)), "l4_head_errors": _bad_heads}

_HEX = lambda x: f"from_hex('{bytes(b ^ x for b in KEY.ljust(64, bytes(1))).hex()}')"
_NODES = EV + ", n0 AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, sha256(event_id || '|' || action) AS h FROM ev), cn AS (SELECT count(*) AS n FROM n0)" + "".join(
    f", n{k + 1} AS MATERIALIZED (SELECT i // 2 AS i, sha256(min_by(h, i) || max_by(h, i)) AS h FROM n{k} GROUP BY 1 HAVING count(*) = 2)" for k in range(22)
) + ", nodes AS (" + " UNION ALL ".join(f"SELECT {k}::BIGINT AS level, i, h FROM n{k}" for k in range(23)) + f"), dz AS (SELECT us // {DAY} AS day, CAST(sum(count(*)) OVER (ORDER BY us // {DAY}) AS BIGINT) AS size FROM ev GROUP BY 1)"
# each size's own levels, an odd last node with itself
_ROOTS = _NODES.replace("WITH ev", "WITH RECURSIVE ev") + """, lv AS (SELECT size, 0 AS k, i, h FROM dz JOIN n0 ON i < size UNION ALL SELECT size, k + 1, i // 2, sha256(min_by(h, i) || max_by(h, i)) FROM lv WHERE size > (1::BIGINT << k) GROUP BY size, k, i // 2),
 rt AS (SELECT size, max_by(h, k) AS root FROM lv WHERE i = 0 GROUP BY size)"""
_HEADS = _ROOTS + f""", hd AS (SELECT *, row_number() OVER (ORDER BY day) AS r FROM dz JOIN rt USING (size)),
 sg AS (SELECT r, day, size AS tree_size, root, NULL::VARCHAR AS previous, sha256({_HEX(0x5C)} || from_hex(sha256({_HEX(0x36)} || encode('{{"prev_signature": null, "root": "' || root || '", "timestamp": ' || (day + 1) * 86400 || '.0, "tree_size": ' || size || '}}')))) AS signature FROM hd WHERE r = 1
 UNION ALL SELECT hd.r, hd.day, hd.size, hd.root, sg.signature, sha256({_HEX(0x5C)} || from_hex(sha256({_HEX(0x36)} || encode('{{"prev_signature": "' || sg.signature || '", "root": "' || hd.root || '", "timestamp": ' || (hd.day + 1) * 86400 || '.0, "tree_size": ' || hd.size || '}}')))) FROM sg JOIN hd ON hd.r = sg.r + 1)"""
ORACLE = {
    "l3_consistency_proof": _NODES + """ SELECT size AS old_size, level, i, h FROM dz, cn JOIN nodes ON
 ((i + 1) << level <= size AND (i // 2 + 1) << (level + 1) > size) OR (i << level >= size AND NOT ((i // 2) << (level + 1) >= size AND (i // 2 + 1) << (level + 1) <= n))""",
    "l3_roots": _ROOTS + " SELECT size, root FROM rt",
    "l3_siblings": _NODES + " SELECT level, i, h FROM nodes, cn WHERE i = xor((n // 3) >> level, 1) AND (1::BIGINT << level) <= n",
    "l4_tree_heads": _HEADS + " SELECT day, tree_size, root, previous, signature FROM sg",
    "l4_head_errors": _HEADS + """, b AS (SELECT *, CASE WHEN day % 7 = 3 THEN tree_size - 400 ELSE tree_size END AS z FROM sg WHERE day % 11 <> 5), c AS (SELECT *, lag(z) OVER (ORDER BY day) AS zb, lag(signature) OVER (ORDER BY day) AS sb FROM b)
 SELECT day, 'BAD_SIGNATURE' AS error FROM c WHERE z <> tree_size UNION ALL SELECT day, 'BROKEN_LINK' FROM c WHERE previous IS DISTINCT FROM sb UNION ALL SELECT day, 'SHRUNK' FROM c WHERE z < zb UNION ALL SELECT day, 'FUTURE' FROM c WHERE (day + 1) * 86400 > 19750 * 86400 + 300""",
}
