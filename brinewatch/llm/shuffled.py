"""Sharding by a two-pass external shuffle of whole records.

First pass: every record goes to a bucket by a seeded hash of its columns; there are as many buckets as keep one at about BUCKET bytes of text, and no fewer
than the session has shuffle partitions. Records that are equal in all columns are numbered within their task and the number hashed too, so that a record
which repeats for a third of the table is dealt over all buckets like any other. Second pass: a task holds one bucket, puts it in order of the hashes and
Fisher-Yates shuffles it with a generator seeded by the bucket, and writes it. Buckets one after another are the order of the whole; shards are equal
runs of it, so their numbers of rows are at most one apart, and a row's slot is its place in its shard.

Both passes give the same when a task runs again: hashes, numbers and generators hang on the rows alone (numbers of equal rows can change places, which changes nothing).
Null texts are empty. Rows without doc_id are records like others. Nothing is dropped; an empty table gives an empty table. Columns keep their names whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from brinewatch.llm.tables import attached, coded, decoded, saved, sorted_groups

BUCKET = 32 << 20
SEED = 7
RUN = 4096


@F.pandas_udf(LongType())
def repeats(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """How often a hash came before in this task."""
    seen: dict[int, int] = {}
    for part in hashes:
        codes, uniq = pd.factorize(part)
        before = np.array([seen.get(h, 0) for h in uniq.tolist()], np.int64)
        order = np.argsort(codes, kind="stable")
        starts = np.searchsorted(codes[order], np.arange(len(uniq)))
        nth = np.empty(len(codes), np.int64)
        nth[order] = np.arange(len(codes)) - starts[codes[order]]
        seen.update(zip(uniq.tolist(), (before + np.bincount(codes, minlength=len(uniq))).tolist(), strict=True))
        yield pd.Series(nth + before[codes])


def shuffled(docs: DataFrame, bucket_bytes: int = BUCKET, seed: int = SEED) -> DataFrame:
    """docs(text, ...) as a table in the shared folder: its columns under numbers, with _bucket and the place in it."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n")).first().n or 0
    buckets = max(-(-total // bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    plain = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    rows = docs.select(*coded(docs.columns), F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in plain]).alias("_hash")).withColumn("_nth", repeats("_hash"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_hash", "_nth"), F.lit(buckets)).cast("int")).drop("_nth")
    rows = rows.repartitionById(buckets, "_bucket").sortWithinPartitions("_bucket", "_hash").drop("_hash")

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in sorted_groups(batches, ["_bucket"]):
            n = bucket.num_rows
            order = np.random.default_rng([seed, bucket.column("_bucket")[0].as_py()]).permutation(n)  # a Fisher-Yates shuffle
            for s in range(0, n, RUN):
                run = bucket.take(pa.array(order[s : s + RUN])).append_column("_place", pa.array(np.arange(s, min(n, s + RUN))))
                yield from run.combine_chunks().to_batches()

    kinds = ", ".join(f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(docs.columns))
    return saved(rows.mapInArrow(permute, f"{kinds}, _bucket int, _place long"), "shuffled")


def starts_of(rows: DataFrame, group: int = RUN) -> DataFrame:
    """(_bucket, start): how many rows the buckets before it have. Sums run within groups of buckets and over the groups, so no task sees all buckets."""
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_group", F.expr(f"_bucket div {group}"))
    groups = sizes.groupBy("_group").agg(F.sum("_n").alias("_of_group"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # a row for every 4096 buckets
    groups = groups.select("_group", F.coalesce(F.sum("_of_group").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(groups, "_group").select("_bucket", (F.col("_before") + F.coalesce(F.sum("_n").over(inner), F.lit(0))).alias("start"))


def sharded(docs: DataFrame, shards: int = 8, bucket_bytes: int = BUCKET, seed: int = SEED) -> DataFrame:
    """docs(text, ...) with _shard (from 0) and _slot (from 0 in each shard); columns of docs of these names are replaced."""
    rows = shuffled(docs, bucket_bytes, seed)
    total = rows.count()
    out = attached(rows, saved(starts_of(rows), "bucket-starts"), "_bucket").withColumn("_position", F.col("start") + F.col("_place"))
    out = out.withColumn("_shard", F.expr(f"cast(_position * {shards} div {max(total, 1)} as int)")).withColumn("_slot", F.expr(f"_position - (_shard * {total}L + {shards - 1}) div {shards}"))
    return out.select(*decoded(docs.columns, ("_shard", "_slot")), "_shard", "_slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, bucket_bytes: int = BUCKET, seed: int = SEED) -> None:
    """Writes the shards as folders _shard=N of Parquet files; a file's rows are in order of their slots, and no two files of a shard interleave where a task reads one bucket."""
    sharded(docs, shards, bucket_bytes, seed).sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


