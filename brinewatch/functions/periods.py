"""Windows over the time of a key that may hold a third of all rows: its history is cut into periods, each a task's work, and what a period needs of those before it is a small table, a row a key and period, whose rows are read ahead of the period's own.

Rows have us (microseconds) and event_id; a key's rows are in the order of both. Null keys are a key of their own, as in windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def cut_up(df: DataFrame, length: int) -> DataFrame:
    """df with its rows' period."""
    return df.withColumn("_p", F.expr(f"(us - pmod(us, {length}L)) div {length}L"))


FIRST, LAST = -(1 << 62), 1 << 62  # before and after all times, with room for sums of times


def led(df: DataFrame, keys: list[str], columns: dict[str, Callable[[str], Column]]) -> DataFrame:
    """df (cut up) with a row ahead of each period's own, marked _added, that holds what the functions (sum, min or max) make of the columns in all of the key's periods before.

    The windows over the period then begin with it, so df isn't joined with what is carried, and dealt out once.
    """
    over = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    some = " or ".join(f"`{c}` is not null" for c in columns)
    table = df.groupBy(*keys, "_p").agg(*(f(c).alias(f"_t{i}") for i, (c, f) in enumerate(columns.items())))
    carried = table.select(*keys, "_p", *(f(f"_t{i}").over(over).alias(c) for i, (c, f) in enumerate(columns.items()))).where(some)
    return df.unionByName(carried.withColumns({"us": F.lit(FIRST).cast("bigint"), "_added": F.lit(True)}), allowMissingColumns=True)


def neighbours(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df (cut up) with _before and _after: structs of the columns in the key's row before and after."""
    row, at = F.struct(*columns), F.struct("us", "event_id")
    if columns == ["us"]:  # numbers alone are grouped by hash, without a sort
        ends = (F.struct(F.min("us").alias("us")), F.struct(F.max("us").alias("us")))
    else:
        ends = (F.min_by(row, at), F.max_by(row, at))
    over = W.partitionBy(*keys).orderBy("_p")
    table = df.groupBy(*keys, "_p").agg(ends[0].alias("_first"), ends[1].alias("_last")).withColumns({"_ended": F.lag("_last").over(over), "_begins": F.lead("_first").over(over)})
    both = F.array(F.struct(F.lit(FIRST).alias("us"), F.col("_ended").alias("_row")), F.struct(F.lit(LAST).alias("us"), F.col("_begins").alias("_row")))
    more = table.select(*keys, "_p", F.lit(True).alias("_added"), F.inline(both)).where("_row is not null")
    own = W.partitionBy(*keys, "_p").orderBy("us", "event_id")
    x = df.withColumn("_row", row).unionByName(more, allowMissingColumns=True)
    return x.withColumns({"_before": F.lag("_row").over(own), "_after": F.lead("_row").over(own)}).where("_added is null").drop("_added", "_row")


def so_far(keys: list[str]) -> W:
    """A period's rows up to each one's time, rows of the same time included."""
    return W.partitionBy(*keys, "_p").orderBy("us").rangeBetween(W.unboundedPreceding, 0)


def before(keys: list[str]) -> W:
    """A period's rows before each one."""
    return W.partitionBy(*keys, "_p").orderBy("us", "event_id").rowsBetween(W.unboundedPreceding, -1)


def running_sum(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """df (cut up) with the sum of a column over the key's rows up to each one's time, rows of the same time included."""
    return led(df, keys, {column: F.sum}).withColumn(name, F.sum(column).over(so_far(keys))).where("_added is null").drop("_added")


def least_before(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """df (cut up) with the smallest value in the key's rows before each one."""
    return led(df.withColumn("_v", value), keys, {"_v": F.min}).withColumn(name, F.min("_v").over(before(keys))).where("_added is null").drop("_added", "_v")


def sliding_count(df: DataFrame, keys: list[str], us: int, name: str) -> DataFrame:
    """df with how many of the key's rows its trailing window holds: every row comes at its time and goes when the window ends after it."""
    come = df.withColumn("_d", F.lit(1))
    gone = df.select(*keys, (F.col("us") + us + 1).alias("us"), F.lit(-1).alias("_d"))
    both = cut_up(come.unionByName(gone, allowMissingColumns=True), 8 * us)
    return running_sum(both, keys, "_d", name).where("event_id is not null").drop("_d", "_p")
