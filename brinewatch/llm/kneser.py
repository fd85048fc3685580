"""Quality by perplexity: an interpolated modified Kneser-Ney model of characters, and quantile thresholds by language.

Trained on all trusted texts (labelled good and not toxic), one row a doc_id, less the fifth whose hashed doc_id is held back. A caller may bound them: sample takes so many of the smallest hashed
doc_id, chars so many characters in all, none of over a quarter of that; what is left out then counts as held back. N-gram counts
are summed in Spark, sharded by n-gram; continuation counts, discounts, context masses and interpolated probabilities come from
joins of one order with the next lower one. All n-grams are kept. Distinct n-grams of characters grow far slower than the texts: while the tables hold at most TABLE rows together they are
broadcast, and every whole text is scored in one pass without a shuffle. Larger ones stay distributed: each distinct n-gram of the texts gets its probability by joins, and the texts' counts are joined with those.

A text's perplexity is per character, with one end. A language's threshold is its centre plus its spread, both in log perplexity. The centre is the median of its held-back texts,
and the spread 1 + MARGIN times the distance from there to their QUANTILE; each is weighed by their number against SHRINK texts' worth of what all languages say: the median of all the language's trusted texts, corrected
by what being fitted lowers it, and the spread of all languages around their own centres. So a rare language keeps its own centre and borrows the spread. A language without trusted texts has the threshold of all texts together.

Null text is empty: it has its end only. A null language is one of its own, and comes back as null. Rows that repeat are judged alike, each comes back (the model is fitted on one row of a doc_id: that of the least text). Without trusted texts every row is kept, with null
perplexity. Further columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from brinewatch.llm.tables import attached, dropped, saved
from brinewatch.llm.words import mix

ORDER = 4
TABLE = 8_000_000
NONE = "\x00none"
QUANTILE = 0.99
MARGIN = 0.5
SHRINK = 50
START, END = 0x110000, 0x110001
NAMES = ("g4", "c4", "g3", "c3", "g2", "c2", "g1")
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
PIECE = 1 << 20


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points with ORDER - 1 starts before and one end after each text, and where each begins (and the end)."""
    head = np.full(ORDER - 1, START, np.uint32)
    tail = np.array([END], np.uint32)
    parts = [x for t in texts for x in (head, np.frombuffer(t.encode("utf-32-le"), np.uint32), tail)]
    sizes = np.array([len(t) + ORDER for t in texts])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.append(0, np.cumsum(sizes))


def grams(c: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-grams that end at each symbol from the n-th on; the key of a suffix is that of the shorter n-gram."""
    x = c.astype(np.uint64) + np.uint64(1)
    out = np.zeros(len(c) - n + 1, np.uint64)
    for d in range(n):  # d places back
        out += mix(x * SEEDS[d])[n - 1 - d : len(c) - d]
    return mix(out + np.uint64(n))


def contexts(c: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n - 1 symbols before each symbol from the n-th on, as n-grams of that order (order 0 has key 0)."""
    return grams(c[:-1], n - 1) if n > 1 else np.zeros(len(c), np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in _runs(batches):
        c, starts = symbols(texts[1])
        k, ctx, low = grams(c, ORDER), contexts(c, ORDER), grams(c, ORDER - 1)[1:]
        real = np.ones(len(k), bool)
        for s in starts[1:-1].tolist():  # none that spans two texts
            real[s - ORDER + 1 : s] = False
        u, at, n = np.unique(k[real], return_index=True, return_counts=True)
        cols = [u, ctx[real][at], low[real][at], contexts(c, ORDER - 1)[1:][real][at], grams(c, ORDER - 2)[2:][real][at], contexts(c, ORDER - 2)[2:][real][at], grams(c, 1)[3:][real][at]]
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in cols] + [pa.array(n.astype(np.int64))], [*NAMES, "n"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of about PIECE characters."""
    for b in batches:
        ids, texts, size = [], [], 0
        for i, t in enumerate(b.column("text").to_pylist()):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= PIECE:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _level(counts: DataFrame, lower: DataFrame, uniform: float) -> tuple[DataFrame, DataFrame]:
    """(g, p) and (c, back) of one order from (g, c, low, n) and the lower order's (g, p): interpolated modified Kneser-Ney."""
    t = {r.n: r.k for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    n1, n2, n3, n4 = (t.get(i, 0) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate((1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5))]
    off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    ctx = counts.groupBy("c").agg(F.sum("n").alias("total"), F.sum(off).alias("mass")).withColumn("back", F.col("mass") / F.col("total"))
    rows = counts.join(ctx, "c").join(lower.select(F.col("g").alias("low"), F.col("p").alias("q")), "low", "left")
    p = (F.col("n") - off) / F.col("total") + F.col("back") * F.coalesce("q", F.lit(uniform))
    return rows.select("g", p.alias("p")), ctx.select("c", "back")


def fit(texts: DataFrame, most: int = TABLE) -> tuple[list, list, float] | None:
    """Sorted (key, probability) and (context, back-off mass) arrays of each order from 1 on, and the uniform share; None without texts. Tables of more than so many rows stay DataFrames."""
    top = saved(texts.mapInArrow(_count, ", ".join(f"{c} long" for c in (*NAMES, "n"))).groupBy(*NAMES).agg(F.sum("n").alias("n")), "ngrams")
    if top.isEmpty():
        return None
    tables = {}
    # lower orders count their distinct left extensions
    counts = {4: top.select(F.col("g4").alias("g"), F.col("c4").alias("c"), F.col("g3").alias("low"), "n")}
    for k, low in ((3, "g2"), (2, "g1")):
        counts[k] = top.select(f"g{k + 1}", f"g{k}", f"c{k}", low).distinct().groupBy(F.col(f"g{k}").alias("g"), F.col(f"c{k}").alias("c"), F.col(low).alias("low")).agg(F.count("*").alias("n"))
    counts[1] = top.select("g2", "g1").distinct().groupBy(F.col("g1").alias("g")).agg(F.count("*").alias("n")).select("g", F.lit(0).cast("bigint").alias("c"), F.lit(0).cast("bigint").alias("low"), "n")
    uniform = 1.0 / (counts[1].count() + 1)
    lower = texts.sparkSession.createDataFrame([(0, uniform)], "g long, p double")
    backs = {}
    for k in range(1, ORDER + 1):
        p, back = _level(counts[k], lower, uniform)
        tables[k], backs[k] = saved(p, f"p{k}"), saved(back, f"back{k}")
        lower = tables[k]

    dropped(top)
    if sum(df.count() for df in (*tables.values(), *backs.values())) > most:
        return list(tables.values()), list(backs.values()), uniform

    def arrays(df: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
        got = df.toPandas()  # at most so many rows
        key = got.iloc[:, 0].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(key)
        return key[order], got[value].to_numpy(float)[order]

    out = [arrays(tables[k], "p") for k in range(1, ORDER + 1)], [arrays(backs[k], "back") for k in range(1, ORDER + 1)], uniform
    for df in (*tables.values(), *backs.values()):
        dropped(df)
    return out


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return np.where(table[0][at] == keys, table[1][at], default)


def log_probabilities(model, texts: list[str]) -> np.ndarray:
    """The log10 probability of each text with its end."""
    probs, backs, uniform = model
    c, starts = symbols(texts)
    top = grams(c, ORDER)
    u, at, where = np.unique(top, return_index=True, return_inverse=True)
    p = np.full(len(u), uniform)
    for n in range(1, ORDER + 1):  # a seen n-gram's own probability, else back-off mass times the lower order's
        g = grams(c, n)[ORDER - n :][at]
        ctx = contexts(c, n)[ORDER - n :][at]
        p = _find(backs[n - 1], ctx, 1.0) * p
        own = _find(probs[n - 1], g, -1.0)
        p = np.where(own >= 0, own, p)
    lp = np.log10(p)[where]
    lp = np.append(np.zeros(ORDER - 1), lp)
    real = np.ones(len(c), bool)
    for s in starts[:-1].tolist():
        real[s : s + ORDER - 1] = False
    return np.add.reduceat(np.where(real, lp, 0.0), starts[:-1]) if texts else np.zeros(0)


def scored(docs: DataFrame, model) -> DataFrame:
    """(doc_id, lang, n_chars, log_perplexity) of docs under a broadcast model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _runs([b]):
                part = b.slice(ids[0], len(ids))
                n = np.array([len(t) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(n, pa.int64()), pa.array(-log_probabilities(model.value, texts) / (n + 1))], ["doc_id", "lang", "n_chars", "log_perplexity"])

    return docs.mapInArrow(run, "doc_id long, lang string, n_chars long, log_perplexity double")


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct top n-grams with the keys of their suffixes and contexts, and how often they occur."""
    for b in batches:
        for key, text in zip(b.column("_key").to_pylist(), b.column("text").to_pylist(), strict=True):
            c, _ = symbols([text])
            u, at, n = np.unique(grams(c, ORDER), return_index=True, return_counts=True)
            cols = [u, contexts(c, ORDER)[at], grams(c, 3)[1:][at], contexts(c, 3)[1:][at], grams(c, 2)[2:][at], contexts(c, 2)[2:][at], grams(c, 1)[3:][at]]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(u), pa.string()), *(pa.array(x.view(np.int64)) for x in cols), pa.array(n.astype(np.int64))], ["_key", *NAMES, "n"])


def scored_by_joins(docs: DataFrame, model) -> DataFrame:
    """What scored gives, from tables that stay distributed; equal texts are scored once."""
    probs, backs, uniform = model
    docs = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_key", F.sha2("text", 256))
    found = saved(docs.groupBy("_key").agg(F.first("text").alias("text")).mapInArrow(_grams_of, "_key string, " + ", ".join(f"{c} long" for c in (*NAMES, "n"))), "text-ngrams")
    p = found.select(*NAMES).distinct().withColumns({"c1": F.lit(0).cast("long"), "p": F.lit(uniform)})
    for n in range(1, ORDER + 1):  # a seen n-gram's own probability, else back-off mass times the lower order's
        p = p.join(backs[n - 1].withColumnRenamed("c", f"c{n}"), f"c{n}", "left").join(probs[n - 1].select(F.col("g").alias(f"g{n}"), F.col("p").alias("own")), f"g{n}", "left")
        p = p.withColumn("p", F.coalesce("own", F.coalesce("back", F.lit(1.0)) * F.col("p"))).drop("own", "back")
    log_p = found.select("_key", "g4", "n").join(p.select("g4", F.log10("p").alias("lp")), "g4").groupBy("_key").agg(F.sum(F.col("n") * F.col("lp")).alias("lp"))
    n_chars = F.length("text").cast("long")
    return docs.join(log_p, "_key").select("doc_id", "lang", n_chars.alias("n_chars"), (-F.col("lp") / (n_chars + 1)).alias("log_perplexity"))


def limits_of(rows: DataFrame) -> tuple[DataFrame, float | None]:
    """(lang, limit) from (lang, log_perplexity, _own), a row for each trusted text, _own null where the model was fitted on it; and the limit of all together."""
    at = lambda c, q: F.percentile_approx(c, q, 10_000)
    whole = rows.agg(at("_own", QUANTILE).alias("q"), at("_own", 0.5).alias("own"), at("log_perplexity", 0.5).alias("all")).first()
    if whole.own is None:  # none is held back
        whole = rows.agg(at("log_perplexity", QUANTILE).alias("q"), at("log_perplexity", 0.5).alias("own"), at("log_perplexity", 0.5).alias("all")).first()
        if whole.own is None:
            return rows.sparkSession.createDataFrame([], "lang string, limit double"), None
    n, fitted = F.col("n"), F.lit(whole.own - whole.all)
    by = rows.groupBy("lang").agg(F.count("_own").alias("n"), at("_own", 0.5).alias("own"), at("_own", QUANTILE).alias("q"), at("log_perplexity", 0.5).alias("all"))
    by = saved(by.withColumn("centre", (F.coalesce(n * F.col("own"), F.lit(0.0)) + SHRINK * (F.col("all") + fitted)) / (n + SHRINK)), "centres")
    around = attached(rows, by.select("lang", "centre"), "lang").agg(at(F.coalesce("_own", "log_perplexity") - F.col("centre"), QUANTILE).alias("q")).first().q
    spread = (F.coalesce(n * (F.col("q") - F.col("own")), F.lit(0.0)) + SHRINK * F.lit(around)) / (n + SHRINK)
    return by.select("lang", (F.col("centre") + (1 + MARGIN) * spread).alias("limit")), whole.q + MARGIN * (whole.q - whole.own)


def perplexities(docs: DataFrame, labels: DataFrame, sample: int | None = None, chars: int | None = None, most: int = TABLE) -> DataFrame:
    """docs(doc_id, text, lang, ...) to (doc_id, lang, n_chars, perplexity, threshold, kept), a row for each of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit(NONE)).alias("lang"))
    said = F.when(F.col("lang") != NONE, F.col("lang")).alias("lang")
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0")
    chosen = good.select("doc_id")
    if sample is not None:
        chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    mine = docs.join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang")).alias("x"))
    # of rows that repeat a doc_id the one of the least text
    trusted = mine.select("doc_id", "x.*")
    if chars is not None:  # texts in the order of their hash, while they fit
        trusted = saved(trusted.withColumn("_h", F.xxhash64("doc_id")).where(F.length("text") <= chars // 4), "trusted")
        sizes = trusted.select("doc_id", F.sum(F.length("text") + 1).over(Window.orderBy("_h", "doc_id")).alias("_sum"))  # ids and sizes of a bounded call only
        trusted = trusted.join(sizes.where(F.col("_sum") <= chars).select("doc_id"), "doc_id", "left_semi")
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0
    fitted = saved(trusted.where(~held).select("doc_id", "text"), "fitted")
    model = fit(fitted.select("text"), *(() if most == TABLE else (most,)))
    if model is None:
        return docs.select("doc_id", said, F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    by_joins = isinstance(model[0][0], DataFrame)
    scores = saved(scored_by_joins(docs, model) if by_joins else scored(docs, spark.sparkContext.broadcast(model)), "scores")
    # all trusted texts count, one row a doc_id; _own is null for those that the model was fitted on
    rows = scores.join(good.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("log_perplexity", "lang")).alias("x")).select("doc_id", "x.*")
    rows = rows.join(fitted.select("doc_id", F.lit(True).alias("_fitted")), "doc_id", "left").withColumn("_own", F.when(F.col("_fitted").isNull(), F.col("log_perplexity")))
    limits, overall = limits_of(saved(rows.select("lang", "log_perplexity", "_own"), "trusted-scores"))
    dropped(fitted)
    out = attached(scores, limits, "lang").withColumn("limit", F.coalesce("limit", F.lit(overall)))
    return out.select("doc_id", said, "n_chars", F.pow(F.lit(10.0), "log_perplexity").alias("perplexity"), F.pow(F.lit(10.0), "limit").alias("threshold"), (F.col("log_perplexity") <= F.coalesce("limit", F.lit(math.inf))).alias("kept"))
