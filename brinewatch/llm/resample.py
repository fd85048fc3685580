"""Target-distribution importance resampling over hashed word runs.

Features of a text are its words and its pairs of neighbouring words (joined by a blank); words are maximal runs of ASCII letters and digits and of characters beyond ASCII,
A-Z lower-cased. A feature's bucket is its CRC-32 modulo BUCKETS. Each task reads its rows into tries of whole documents, a few megabytes at a time: the root's children
are words, theirs the words that follow; a node holds its count and the CRC state of the way to it, and a child's state goes on from its parent's, so that no pair is ever spelled
out. First pass: bucket totals of documents and of target texts, one row of BUCKETS counts a task, summed. Then each bucket has a gain, in thousandths of a natural log, and the second pass attaches gains to
the tries' nodes and walks every document's way through them. A document's weight is the floored mean; with its own Gumbel noise, drawn from its doc_id, the highest scores are a draw without replacement in proportion to exp(weight / 1000).

Ranks need no total order in one task: scores are whole numbers between fixed bounds (some 100,000 at most), so counts by score say where each score's run begins, and only rows of equal
score are put in order, by doc_id, equal rows as one with a count.

Null and empty texts have no features and weight 0. Rows without doc_id draw the noise of an empty id and stand behind equal scores. Rows that repeat count each and come back each. Further columns are left
alone by importance and kept by resampled. Empty tables give an empty table; without target texts all gains tell only how common a bucket is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from brinewatch.llm.tables import attached, saved
from brinewatch.llm.words import LOWER, SIGNS, Words, word_batches

BUCKETS = 10_000
SEED = 7
SHARE = 25
LEAST = 20
BLOCK = 1 << 22
SHORT = 64
RUN = 10_000
_zeros: list[np.ndarray] = []


def advanced(states: np.ndarray, n: int) -> np.ndarray:
    """CRC states after n zero bytes, n up to SHORT: they are linear in a state's bits, so four look-ups by its bytes give it."""
    if not _zeros:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
        table = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for _ in range(SHORT + 1):
            _zeros.append(table)
            table = step[table & np.uint32(255)] ^ (table >> np.uint32(8))
    t, byte = _zeros[n], np.uint32(255)
    return t[0][states & byte] ^ t[1][states >> np.uint32(8) & byte] ^ t[2][states >> np.uint32(16) & byte] ^ t[3][states >> np.uint32(24)]


class Trie:
    """A block's words and, below each, the words that follow it. Node numbers of words come first, then those of pairs.

    crc and count are by node, parent by pair; word and pair give every place of the text its two nodes (pair is -1 at a document's last word).
    """

    def __init__(self, w: Words) -> None:
        self.word, words = pd.factorize(w.hashes)
        n = len(words)
        first = np.empty(n, np.int64)
        first[self.word[::-1]] = np.arange(len(self.word))[::-1]
        spelled = [LOWER[w.data[s:e]].tobytes() for s, e in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)]
        state = np.array([zlib.crc32(x) for x in spelled], np.uint32)
        follows = np.flatnonzero(w.doc[1:] == w.doc[:-1])
        self.pair = np.full(len(self.word), -1, np.int64)
        codes, keys = pd.factorize(self.word[follows] * n + self.word[follows + 1])
        self.pair[follows] = codes + n
        self.parent, last = keys // max(n, 1), keys % max(n, 1)
        child = np.empty(len(keys), np.uint32)
        alone = np.array([zlib.crc32(b" " + x) for x in spelled], np.uint32)
        size = np.array([len(x) + 1 for x in spelled], np.int64)[last]
        for k in np.unique(size).tolist():
            at = np.flatnonzero(size == k)
            if k <= SHORT:
                child[at] = advanced(state[self.parent[at]], k) ^ alone[last[at]]
            else:  # a long word is read after each parent; together they are no longer than the text
                child[at] = [zlib.crc32(b" " + spelled[x], int(state[p])) for p, x in zip(self.parent[at].tolist(), last[at].tolist(), strict=True)]
        self.crc = np.append(state, child)
        self.count = np.append(np.bincount(self.word, minlength=n), np.bincount(codes, minlength=len(keys)))

    def totals(self, buckets: int) -> np.ndarray:
        return np.bincount(self.crc % np.uint32(buckets), self.count, buckets).astype(np.int64)

    def walked(self, gains: np.ndarray) -> np.ndarray:
        """The gains along each place's way: its word's and its pair's."""
        at = gains[self.crc % np.uint32(len(gains))]
        return at[self.word] + np.where(self.pair >= 0, at[self.pair], 0)


def totals(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(buckets, np.int64)
        for b in batches:
            for w in word_batches(b.column("text"), BLOCK, SIGNS):
                mine += Trie(w).totals(buckets)
        some = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(mine[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t, k = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a digest."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, ...) with _n_words, _n_features, _weight and _score; only texts pass through Python."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(totals(docs, buckets), totals(target, buckets)))

    @F.arrow_udf("n_words long, n_features long, weight long")
    def walk(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            words, total = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
            for w in word_batches(column, BLOCK, SIGNS):
                words[w.first : w.first + w.n] = np.diff(w.bounds())
                total[w.first : w.first + w.n] = np.bincount(w.doc - w.first, Trie(w).walked(gain.value), w.n).astype(np.int64)  # far below 2**53: exact
            n = words + np.maximum(words - 1, 0)
            yield pa.StructArray.from_arrays([pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], ["n_words", "n_features", "weight"])

    out = docs.withColumn("_walk", walk("text"))
    out = out.withColumns({"_n_words": F.col("_walk.n_words"), "_n_features": F.col("_walk.n_features"), "_weight": F.col("_walk.weight")}).drop("_walk")
    return out.withColumn("_score", F.col("_weight") + noise(F.col("doc_id"), seed))


def begun(rows: DataFrame) -> DataFrame:
    """(_score, start) from rows(_score, n): how many rows have a higher score. Scores are whole numbers between fixed bounds."""
    sums = rows.groupBy("_score").agg(F.sum("n").alias("n"))
    return sums.select("_score", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("_score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))


def importance(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n_features, weight, score, rank), a row for each of docs; rank is null for what isn't drawn.

    Of the N rows with at least so many words, N * share div 100 are drawn.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = saved(scored(slim, target, buckets, seed).select("doc_id", "_n_features", "_weight", "_score", (F.col("_n_words") >= least).alias("_able")), "resample-scores")
    names = ("doc_id", "_n_features", "_weight", "_score")
    able = rows.where("_able").groupBy(*names).agg(F.count("*").alias("n"))
    drawn = (rows.where("_able").count() * share) // 100
    starts = saved(begun(able), "resample-starts")
    marked = attached(able, starts, "_score").where(F.col("start") < drawn)
    before = Window.partitionBy("_score").orderBy(F.expr("doc_id is null"), "doc_id", "_n_features", "_weight").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("start") + F.coalesce(F.sum("n").over(before), F.lit(0))
    runs = marked.withColumn("_first", first).withColumn("_run", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")))  # no array holds more than RUN
    one = runs.withColumn("_place", F.explode(F.expr(f"sequence(_run * {RUN}, least(n, (_run + 1) * {RUN}) - 1)")))
    rank = F.col("_first") + F.col("_place") + 1
    rest = attached(rows, starts.withColumn("_out", F.col("start") >= drawn).select("_score", "_out"), "_score").where(~F.col("_able") | F.col("_out"))
    out = one.select(*names, F.when(rank <= drawn, rank).alias("rank")).unionAll(rest.select(*names, F.lit(None).cast("long").alias("rank")))
    return out.select("doc_id", F.col("_n_features").alias("n_features"), F.col("_weight").alias("weight"), F.col("_score").alias("score"), "rank")


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The rows of docs that are drawn, in no order. Rows of the last drawn score and doc_id come all (a doc_id that doesn't repeat has one)."""
    rows = saved(scored(docs, target, buckets, seed), "resample-rows")
    able = rows.where(F.col("_n_words") >= least)
    drawn = (able.count() * share) // 100
    starts = begun(able.groupBy("_score").agg(F.count("*").alias("n")))
    last = starts.where(F.col("start") < drawn).orderBy(F.desc("start")).limit(1).first() if drawn else None
    if last is None:
        return rows.where("false").select(*docs.columns)
    id_last = able.where(F.col("_score") == last._score).orderBy(F.expr("doc_id is null"), "doc_id").limit(drawn - last.start).agg(F.max(F.expr("doc_id is null")).alias("none"), F.max("doc_id").alias("id")).first()
    tied = F.lit(True) if id_last.none else F.col("doc_id") <= id_last.id
    return able.where((F.col("_score") > last._score) | ((F.col("_score") == last._score) & tied)).select(*docs.columns)


