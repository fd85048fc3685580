"""Inputs: the driver's tables, and their reading as identity events.

An identity is a user, an action an event type, a resource "res-" and the number in props. Event times stay as they
are in batch; us holds them as microseconds, for frames over time. Purchases stand in for privileged actions, errors for failures.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where it names none: our own on one machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or "/tmp/brinewatch-checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, us, actor, action, resource, k, value."""
    k = F.regexp_extract("props", "([0-9]+)", 1)
    return read(spark, sf_dir, "events").select("event_id", "ts", micros(F.col("ts")).alias("us"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.concat(F.lit("res-"), k).alias("resource"), k.cast("bigint").alias("k"), "value")


#: The same in DuckDB, for oracles.
EV = """WITH ev AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id AS actor, event_type AS action, 'res-' || regexp_extract(props, '([0-9]+)', 1) AS resource,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, value FROM events)"""

DAY = 86_400_000_000
HOUR = 3_600_000_000
