"""Running sums and the row before, over rows in one order, without one task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows (or places) in a group; groups of groups are summed in one window, a row for each.
WIDTH = 4096


def sums_before(df: DataFrame, place: str, sums: dict[str, str | Column]) -> DataFrame:
    """df with the sums (name: column) over all rows of a smaller place; places are whole numbers and don't repeat.

    Sums run within groups of WIDTH places and over the groups' sums: of a billion places one window sees a quarter of a million rows.
    """
    x = df.withColumn("_g", F.expr(f"`{place}` div {WIDTH}"))
    for name, c in sums.items():
        x = x.withColumn(f"_v_{name}", c if isinstance(c, Column) else F.col(c))
    groups = x.groupBy("_g").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    over = W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("_g", *(F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_b_{n}") for n in sums))
    inner = W.partitionBy("_g").orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    x = x.join(groups, "_g")
    return x.select(*df.columns, *((F.col(f"_b_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inner), F.lit(0))).alias(n) for n in sums))


def value_before(df: DataFrame, place: str, column: str, name: str) -> DataFrame:
    """df with the column's value in the row of the next smaller place that there is (null in the first)."""
    x = df.withColumn("_g", F.expr(f"`{place}` div {WIDTH}"))
    ends = x.groupBy("_g").agg(F.max_by(column, place).alias("_g_last"))
    ends = ends.select("_g", F.lag("_g_last").over(W.orderBy("_g")).alias("_g_end"))
    w = W.partitionBy("_g").orderBy(place)
    return x.join(ends, "_g").withColumn(name, F.when(F.row_number().over(w) == 1, F.col("_g_end")).otherwise(F.lag(column).over(w))).drop("_g", "_g_end")
