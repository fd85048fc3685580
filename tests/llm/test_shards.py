"""Shards: whole records, equal counts, gapless slots, an even shuffle, also where one record repeats for most of a table."""

from __future__ import annotations

import collections
import glob

import pyarrow.parquet as pq
import pytest

from brinewatch.llm import queries, shuffled


def laws(rows, shards, n):
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["_shard"]].append(r["_slot"])
    assert sum(map(len, slots.values())) == n and set(slots) <= set(range(shards))
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())


@pytest.mark.parametrize("shards", [1, 3, 8, 40])
def test_awkward_rows_come_back_whole(spark, awkward, shards):
    docs = awkward.withColumn("_shard", shuffled.F.lit("mine")).withColumn("_bucket", shuffled.F.lit(5)).withColumn("list", shuffled.F.array("doc_id"))
    out = shuffled.sharded(docs, shards)
    assert out.columns == [*[c for c in docs.columns if c != "_shard"], "_shard", "_slot"]
    rows = out.collect()
    laws(rows, shards, docs.count())
    kept = [c for c in docs.columns if c != "_shard"]
    assert sorted(repr(tuple(r[c] for c in kept)) for r in rows) == sorted(repr(tuple(r)) for r in docs.select(*kept).collect())


def test_empty_table(spark, nothing):
    assert shuffled.sharded(nothing).collect() == []


def test_one_record_that_repeats_is_dealt_over_all_buckets(spark):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, id, 5) AS doc_id", "if(id % 3 = 0, concat('text ', id), 'same') AS text")
    out = shuffled.shuffled(docs, bucket_bytes=1000)
    per = {r["_bucket"]: (r["n"], r["same"]) for r in out.groupBy("_bucket").agg(shuffled.F.count("*").alias("n"), shuffled.F.count_if(shuffled.F.col("_c1") == "same").alias("same")).collect()}
    assert len(per) >= 19 and max(n for n, _ in per.values()) < 3 * 3000 / len(per) and min(s for _, s in per.values()) > 0
    laws(shuffled.sharded(docs, 7, bucket_bytes=1000).collect(), 7, 3000)


def test_the_order_is_the_same_again_and_mixed(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    places = [{r.doc_id: (r["_shard"], r["_slot"]) for r in shuffled.sharded(d, 4, bucket_bytes=4000).collect()} for d in (docs, docs.repartition(5))]
    assert places[0] == places[1]
    other = {r.doc_id: (r["_shard"], r["_slot"]) for r in shuffled.sharded(docs, 4, bucket_bytes=4000, seed=8).collect()}
    assert sum(other[i] == places[0][i] for i in other) < 20
    # neighbours part: in a uniform shuffle a quarter of them share a shard
    together = sum(places[0][i][0] == places[0][i + 1][0] for i in range(1999))
    assert 400 < together < 600


def test_files_hold_the_slots_in_order(spark, tmp_path):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    shuffled.write_shards(docs, f"{tmp_path}/out", 3, bucket_bytes=1000)
    seen = collections.Counter()
    for s in range(3):
        for f in glob.glob(f"{tmp_path}/out/_shard={s}/*.parquet"):
            slots = pq.ParquetFile(f).read(["_slot"]).column(0).to_pylist()
            assert slots == sorted(slots)
            seen[s] += len(slots)
    assert sorted(seen.values()) == [166, 167, 167]


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op12_shards(spark, sf).collect()
    want = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    import zlib

    assert {r.doc_id: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in want.items()}
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    laws([{"_shard": r["shard"], "_slot": r["slot"]} for r in rows], 8, len(want))
