"""Small helpers shared by the operators: reading inputs, cutting lineage, streaming sorted groups."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where it names none: our own on one machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or "/tmp/brinewatch-checkpoints"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what saved wrote for df, once nothing that is still to run reads it."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Yields a table per run of equal keys from batches that arrive sorted by them. Only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[s] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)


SMALL_ROWS = 100_000


def attached(df: DataFrame, small: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """df left-joined to small (one row a key, no null keys) on key.

    A small table of at most SMALL_ROWS rows is broadcast, after counting it. A larger one is repeated salts times and
    joined on key and salt, so one key with a third of df's rows is spread over salts tasks. The salt is a hash of the row,
    so a task that runs again deals alike (equal rows share one).
    """
    if small.count() <= SMALL_ROWS:
        return df.join(F.broadcast(small), key, "left")
    salt = unused("salt", df, small)
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    salted = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(salts)).cast("int")).join(salted, [key, salt], "left").drop(salt)


def coded(names: list[str]) -> list[Column]:
    """Columns under numbers, so that an operator's own names can't clash with them; each is still pruned where nothing asks for it."""
    return [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)]


def decoded(names: list[str], but: tuple[str, ...] = ()) -> list[Column]:
    """The columns under their names again, but for some."""
    return [F.col(f"_c{i}").alias(c) for i, c in enumerate(names) if c not in but]


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has (names don't differ by case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hub_joined(df: DataFrame, table: DataFrame, key: str, rows: int) -> DataFrame:
    """df left-joined to table (one row a key) on key; rows is what df has, and no less than what table has.

    Up to SMALL_ROWS rows, table is broadcast. Beyond, keys with more than a share of df's rows, of which there can't be more than SMALL_ROWS,
    are joined by broadcast and all others by a plain join: no task gets all rows of a key that many share.
    """
    if rows <= SMALL_ROWS:
        return df.join(F.broadcast(table), key, "left")
    hubs = df.groupBy(key).agg(F.count("*").alias("_hub_rows")).where(F.col("_hub_rows") > rows // SMALL_ROWS + 1000).select(key)
    rest = df.join(F.broadcast(hubs), key, "left_anti").join(table, key, "left")
    theirs = hubs.join(F.broadcast(table.join(F.broadcast(hubs), key, "left_semi")), key, "left")
    return rest.unionByName(df.join(F.broadcast(theirs), key))
