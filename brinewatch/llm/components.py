"""Connected components by alternating star contractions, all in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from brinewatch.llm.tables import dropped, hub_joined, saved


FILE_ROWS = 100_000  # edges in a file, about: a round of few edges writes few files


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is its smallest node.

    Each round hangs every node's larger neighbours, then its smaller ones, below the smallest node seen (large star,
    small star), which needs about log2(n) rounds. Smallest nodes are partial minima; they come back to edges by hub_joined, so a hub's
    edges never meet in one task. Self-loops keep single nodes. An empty table gives an empty table. Each round's table is deleted when the next
    one is written. At the end each node has one edge, to its component.
    """

    def written(df: DataFrame, step: str, files: int | None = None) -> tuple[DataFrame, dict]:
        seen = Observation()
        out = saved((df.coalesce(files) if files else df).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), f"{name}-{step}")
        return out, seen.get

    e, before = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    for k in range(rounds if before["n"] else 0):
        # a node's smallest neighbour stands in its own rows (v <= u)
        above = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = hub_joined(e, above, "v", before["n"]).select("u", F.coalesce("m", "v").alias("v"))
        small = hub_joined(large, large.groupBy("u").agg(F.min("v").alias("m")), "u", before["n"])
        hung, now = written(small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u >= v").distinct(), str(k), 8 + before["n"] // FILE_ROWS)
        dropped(e)
        e = hung
        if now == before:
            break
        before = now
    else:
        if before["n"]:
            raise RuntimeError(f"no fixpoint in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
