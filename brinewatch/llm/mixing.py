"""Temperature mixing: sources weighed by a power of their token shares, realised as budgeted block permutations.

All in DataFrame functions. Source s of T_s tokens gets weight w_s = p_s**a / sum(p**a) of its share p_s. The exponent a is
found by repeated section, so that the weights' entropy or the most repeated source meets a target. Under a budget of B
tokens a source is passed through w_s * B / T_s times: whole passes, then a part of one. Without a budget, B is the
least that uses every document once (nothing is dropped). Documents are dealt to blocks of about BLOCK_ROWS by a hash; blocks of a
source are permuted by a seeded hash (heaps of blocks, then blocks within a heap), and documents within a block. A part of a pass takes blocks in that order up to its
budget; only the last block is cut. Token offsets are heap and block offsets plus running sums within a block, so no source is ever ordered in one task.

A document has its words and one more as tokens, so empty and null texts weigh one. A null source is a source of its
own. Rows that repeat are mixed as rows; rows without doc_id are dealt to blocks by their place in the input, which should be a stored table.
An empty table gives an empty table. Further columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brinewatch.llm.tables import attached, coded, decoded, saved

BLOCK_ROWS = 2048
HEAP = 2048
SECTIONS = 16
NONE = "\x00none"


def tokens(text: Column) -> Column:
    return (F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1).cast("bigint")


def _measured(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy in bits, times that the most repeated source repeats where the least repeated one has one pass) at each exponent."""
    lp = F.col("lp")
    cols = [c for i, a in enumerate(exponents) for c in (F.sum(F.exp(a * lp)).alias(f"z{i}"), F.sum(F.exp(a * lp) * lp).alias(f"m{i}"), (F.max((a - 1) * lp) - F.min((a - 1) * lp)).alias(f"r{i}"))]
    row = shares.agg(*cols).first()
    return [((math.log(row[f"z{i}"]) - a * row[f"m{i}"] / row[f"z{i}"]) / math.log(2), math.exp(min(700.0, row[f"r{i}"]))) for i, a in enumerate(exponents)]


def exponent(shares: DataFrame, entropy: float | None = None, repetition: float | None = None) -> float:
    """The largest exponent in 0 .. 1 whose entropy is at least the target, or the least whose repetition stays within the limit.

    shares has lp, the logarithm of each source's share. Where the target can't be met, the nearest end.
    """
    lo, hi = 0.0, 1.0  # entropy and repetition fall as the exponent rises
    for _ in range(6):  # sections of sections: 16**-6
        marks = [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS + 1)]
        got = _measured(shares, marks)
        ok = [(h >= entropy) if entropy is not None else (r > repetition * (1 + 1e-12)) for h, r in got]
        last = max((i for i, x in enumerate(ok) if x), default=-1)
        if last == SECTIONS:
            return hi
        if last < 0:
            return lo
        lo, hi = marks[last], marks[last + 1]
    return lo if entropy is not None else hi


#: The columns that mixed adds.
ADDED = ("_copy", "_weight", "_tokens", "_offset", "_position")


def _starts(sizes: DataFrame, seed: int) -> DataFrame:
    """(_source, _block, _start): how many tokens stand before each block in its source's permutation.

    Blocks are permuted within heaps of about HEAP of them, and the heaps of a source among each other, so no task orders all blocks of a source.
    """
    heap = F.pmod(F.xxhash64(F.lit(seed + 3), "_block"), F.ceil(F.col("_blocks") / HEAP))
    sizes = sizes.withColumn("_heap", heap)
    before = lambda keys, at: F.coalesce(F.sum("_size").over(W.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed + 1), at, "_source"), at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heaps = sizes.groupBy("_source", "_heap").agg(F.sum("_size").alias("_size"))
    heaps = heaps.select("_source", "_heap", before(["_source"], "_heap").alias("_before"))
    inner = sizes.withColumn("_inner", before(["_source", "_heap"], "_block"))
    return inner.join(heaps, ["_source", "_heap"]).select("_source", "_block", (F.col("_before") + F.col("_inner")).alias("_start"))


def mixed(docs: DataFrame, entropy: float | None = None, repetition: float | None = 2.0, budget: int | None = None, source: str = "source", seed: int = 17) -> DataFrame:
    """docs, each row as often as it is drawn, with _copy (from 0), _weight (its source's), _tokens, _offset (of the token at
    which it begins among its source's) and _position (0 to 1: rows in its order are the mixture). Columns of docs of these names are replaced.

    Give a target entropy in bits, or else a repetition limit.
    """
    docs = docs.drop(*ADDED)
    key = F.coalesce(F.col(source).cast("string"), F.lit(NONE))
    identity = F.xxhash64(F.lit(seed), *[c for c in ("doc_id", "text") if c in docs.columns])
    if "doc_id" in docs.columns:  # rows without one may be equal in all they have: they are dealt by where they stand
        identity = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), F.monotonically_increasing_id())).otherwise(identity)
    rows = docs.select(*coded(docs.columns), key.alias("_source"), tokens(F.col("text")).alias("_tokens"), identity.alias("_deal"))
    totals = saved(rows.groupBy("_source").agg(F.count("*").alias("_rows"), F.sum("_tokens").alias("_total")), "sources")
    whole = totals.agg(F.sum("_total")).first()[0]
    lp = F.log(F.col("_total") / F.lit(float(whole or 1)))
    a = exponent(totals.select(lp.alias("lp")), entropy, repetition) if whole else 1.0
    z = totals.agg(F.sum(F.exp(a * lp)).alias("z"), F.max((1 - a) * lp).alias("least")).first()
    if budget is None:  # the source with the smallest weight for its size has one pass
        budget = float(whole or 0) * math.exp(z.least) * z.z if whole else 0.0
    weighed = totals.withColumn("_weight", F.exp(a * lp) / F.lit(z.z or 1.0)).withColumn("_passes", F.round(F.col("_weight") * F.lit(float(budget)) / F.col("_total"), 9))
    weighed = weighed.withColumn("_blocks", F.ceil(F.col("_rows") / BLOCK_ROWS)).drop("_rows")
    rows = attached(rows, weighed, "_source").withColumn("_block", F.pmod("_deal", F.col("_blocks")))
    sizes = rows.groupBy("_source", "_block", "_blocks").agg(F.sum("_tokens").alias("_size"))
    inner = W.partitionBy("_source", "_block").orderBy(F.xxhash64("_deal", F.lit(seed + 2)), "_deal").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(_starts(sizes, seed), ["_source", "_block"]).withColumn("_offset", F.col("_start") + F.coalesce(F.sum("_tokens").over(inner), F.lit(0)))
    part = (F.col("_passes") - F.floor("_passes")) * F.col("_total")
    copies = F.floor("_passes") + F.when(F.col("_offset") < part, 1).otherwise(0)
    drawn = placed.withColumn("_n", copies.cast("bigint")).where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    position = (F.col("_copy") * F.col("_total") + F.col("_offset")) / (F.col("_passes") * F.col("_total"))
    return drawn.withColumn("_position", position).select(*decoded(docs.columns), *ADDED)
