"""Ranked lexical search: a two-level quantised index over blocks of whole documents.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased, known by 64-bit hashes (two of them share one with a
probability of about 2**-64). A row of the index is a block of about a megabyte of text: its terms with the documents that hold them; level 1 is a byte
for each posting, the term's impact in the document rounded up to a multiple of STEP; level 2 is the exact term count and each document's length norm.

A search reads level 1 of all blocks. The bytes bound each document's score from above and, one step less a posting, from below; every task keeps the k
best lower bounds of each query, and the k-th best of all is the query's bar. Then every document whose upper bound reaches the bar is scored exactly, in
whole numbers, from level 2 (no other can be among the k best), and the k best of each task meet in one window. No posting is shuffled.

Queries are taken in groups of about GROUP terms, so that what is broadcast and kept a task has a stated size, however many queries there are. Null and
empty texts, and those without a term, are in no index and match nothing. Rows of one query id are one query of all their terms; a null id is one too. Documents
that repeat count each and come back each; without doc_id they stand behind equal scores. Further columns are left alone. Empty tables give an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from brinewatch.llm.tables import dropped, saved
from brinewatch.llm.words import SIGNS, text_buffer, word_batches

BLOCK = 1 << 20
STEP = 3922  # 255 steps hold every impact, which is under a million
GROUP = 100_000
NO_ID = np.iinfo(np.int64).max


def lengths(column: pa.Array) -> np.ndarray:
    """How many terms each text has."""
    data, off = text_buffer(column)
    out = np.zeros(len(column), np.int64)
    for s in range(int(off[0]), int(off[-1]), BLOCK):
        e = min(s + BLOCK, int(off[-1]))
        term = ~SIGNS[data[max(s - 1, off[0]) : e]]
        begins = term.copy()
        begins[1:] &= ~term[:-1]
        begins = begins[len(begins) - (e - s) :]
        at = off[(off >= s) & (off < e)]
        begins[at - s] = ~SIGNS[data[at]]  # a text's first term begins with it
        out += np.bincount(np.searchsorted(off, np.flatnonzero(begins) + s, "right") - 1, minlength=len(out))
    return out


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * norm)


@dataclass
class Index:
    """Blocks as a table in the shared folder, the number of documents with a term, and of all terms with repeats."""

    blocks: DataFrame
    documents: int
    terms: int


FIELDS = "doc_ids array<long>, norms binary, terms binary, starts binary, docs binary, bytes binary, counts binary"


def build(docs: DataFrame) -> Index:
    """The index of docs(doc_id, text, ...): one pass counts terms, for the length norms, a second writes both levels."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = terms = 0
        for b in batches:
            each = lengths(b.column("text"))
            n, terms = n + int((each > 0).sum()), terms + int(each.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([terms])], ["n", "terms"])

    all_of = docs.select("text").mapInArrow(count, "n long, terms long").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    n, terms = all_of.n or 0, all_of.terms or 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in word_batches(b.column("text"), BLOCK, SIGNS):
                if not len(w.hashes):
                    continue
                each = np.diff(w.bounds())
                held = np.flatnonzero(each)
                norms = 50 + (50 * each[held] * n) // terms
                codes, uniq = pd.factorize(w.hashes)
                order = np.argsort(uniq)
                rank = np.empty(len(uniq), np.int64)
                rank[order] = np.arange(len(uniq))
                doc = np.searchsorted(held, w.doc - w.first)
                posting, tf = np.unique(rank[codes] * len(held) + doc, return_counts=True)
                term, doc = posting // len(held), posting % len(held)
                level = -(-impacts(tf, norms[doc]) // STEP)
                starts = np.searchsorted(term, np.arange(len(uniq) + 1))
                ids = b.column("doc_id").slice(w.first, w.n).take(pa.array(held))
                small = np.uint16 if len(held) <= 1 << 16 else np.uint32
                packed = (norms, uniq[order], starts.astype(np.int32), doc.astype(small), level.astype(np.uint8), tf.astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], [f.split()[0] for f in FIELDS.split(", ")])

    return Index(saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, FIELDS), "ranked-index"), n, terms)


def asked(queries: DataFrame, name: str) -> DataFrame:
    """(name, term) of queries(name, text), each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in word_batches(b.column("text"), BLOCK, SIGNS):
                rows = b.column(0).take(pa.array(w.doc))
                yield pa.RecordBatch.from_arrays([rows, pa.array(w.hashes.view(np.int64))], [name, "term"])

    kind = queries.schema[name].dataType.simpleString()
    return queries.select(F.col(f"`{name}`"), "text").mapInArrow(run, f"`{name}` {kind}, term long").distinct()


class Asked:
    """The terms of a group of queries, sorted, and each query's terms with their weights."""

    def __init__(self, query: np.ndarray, term: np.ndarray) -> None:
        self.terms, place = np.unique(term.astype(np.int64).view(np.uint64), return_inverse=True)
        order = np.argsort(query, kind="stable")
        self.place = place[order]
        self.bounds = np.searchsorted(query[order], np.arange(int(query.max()) + 2))
        self.weights = np.zeros(len(self.terms), np.int64)

    def found(self, terms: np.ndarray) -> np.ndarray:
        """Where each of the asked terms stands among a block's sorted terms, or -1."""
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        return np.where(terms[at] == self.terms, at, -1)

    def postings(self, found: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each query: the postings of its terms, and the term's weight beside each."""
        for q in range(len(self.bounds) - 1):
            mine = self.place[self.bounds[q] : self.bounds[q + 1]]
            mine = mine[found[mine] >= 0]
            if len(mine):
                s, e = starts[found[mine]], starts[found[mine] + 1]
                size = e - s
                ends = np.cumsum(size)
                yield q, np.arange(ends[-1]) + np.repeat(s - ends + size, size), np.repeat(self.weights[mine], size)


def _array(b: pa.RecordBatch, name: str, i: int, kind: type) -> np.ndarray:
    return np.frombuffer(b.column(name)[i].as_buffer(), kind)


def _summed(docs: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(docs, values, n).astype(np.int64)  # sums stay far below 2**53: exact


def _bounds(b: pa.RecordBatch, i: int, asks: Asked) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each query with a term in block i: its postings, their documents and weights, and all documents' upper and lower bounds."""
    terms, starts, level = _array(b, "terms", i, np.uint64), _array(b, "starts", i, np.int32), _array(b, "bytes", i, np.uint8)
    wide = b.column("docs")[i].as_buffer().size > 2 * len(level)
    docs, n = _array(b, "docs", i, np.uint32 if wide else np.uint16), len(b.column("norms")[i].as_buffer()) // 8
    for q, at, weight in asks.postings(asks.found(terms), starts):
        mine, up = docs[at], weight * level[at].astype(np.int64) * STEP
        upper = _summed(mine, up, n)
        yield q, at, mine, weight, upper, upper - _summed(mine, weight * np.where(level[at] > 0, STEP - 1, 0), n)


def search(index: Index, queries: DataFrame, k: int = 50, name: str = "item_id") -> DataFrame:
    """(name, rank, doc_id, score): each query's k best documents with a score above 0, equal scores by ascending doc_id."""
    spark = queries.sparkSession
    pairs = saved(asked(queries, name), "ranked-asked")
    groups = -(-pairs.count() // GROUP)
    key = F.col(f"`{name}`")
    results, tables = None, []
    for g in range(groups):
        rows = pairs.where(F.pmod(F.xxhash64(key), F.lit(groups)) == g).toArrow()  # about GROUP rows
        if not rows.num_rows:
            continue
        names = rows.column(name).combine_chunks().dictionary_encode("encode")
        asks = Asked(names.indices.to_numpy(), rows.column("term").to_numpy())
        best = saved(_group(index, asks, k), "ranked-best")
        known = spark.createDataFrame(list(enumerate(names.dictionary.to_pylist())), f"query int, `{name}` {pairs.schema[name].dataType.simpleString()}")
        tables.append(best)
        part = best.join(F.broadcast(known), "query").select(key, F.col("place").alias("rank"), F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score")  # known: under GROUP rows
        results = part if results is None else results.unionAll(part)
    if results is None:
        return spark.createDataFrame([], f"`{name}` {pairs.schema[name].dataType.simpleString()}, rank int, doc_id long, score long")
    dropped(pairs)
    if groups == 1:
        return results
    out = saved(results, "ranked")
    for t in tables:
        dropped(t)
    return out


def _group(index: Index, asks: Asked, k: int) -> DataFrame:
    """(query, doc, score, place) for one group of queries."""
    context, n = index.blocks.sparkSession.sparkContext, len(asks.bounds) - 1

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.terms), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                at = shared.value.found(_array(b, "terms", i, np.uint64))
                starts = _array(b, "starts", i, np.int32)
                total[at >= 0] += (starts[at[at >= 0] + 1] - starts[at[at >= 0]])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    shared = context.broadcast(asks)  # about GROUP terms
    df = index.blocks.select("terms", "starts").mapInArrow(held, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # a row a term asked for
    for term, count in zip(df.term.tolist(), df.df.tolist(), strict=True):
        asks.weights[term] = math.floor(1000 * math.log((2 * index.documents + 2) / (2 * count + 1)))
    weighted = context.broadcast(asks)

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64)] * n
        for b in batches:
            for i in range(b.num_rows):
                for q, *_, low in _bounds(b, i, weighted.value):
                    low = low[low > (best[q][0] if len(best[q]) == k else 0)]
                    if len(low):
                        best[q] = np.sort(np.append(best[q], low))[-k:]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in best])), pa.array(np.concatenate(best))], ["query", "low"])

    lows = index.blocks.select("norms", "terms", "starts", "docs", "bytes").mapInArrow(lower, "query int, low long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))
    bars = np.ones(n, np.int64)
    for r in lows.withColumn("place", place).where(F.col("place") == k).collect():  # a row a query of the group
        bars[r["query"]] = max(1, r["low"])
    bar = context.broadcast(bars)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        for b in batches:
            for i in range(b.num_rows):
                tf, norms = _array(b, "counts", i, np.uint32), _array(b, "norms", i, np.int64)
                ids = b.column("doc_ids")[i].values.fill_null(NO_ID).to_numpy()
                for q, at, mine, weight, upper, _ in _bounds(b, i, weighted.value):
                    some = upper >= bar.value[q]
                    if not some.any():
                        continue
                    chosen = some[mine]
                    mine = mine[chosen]
                    score = _summed(mine, weight[chosen] * impacts(tf[at[chosen]].astype(np.int64), norms[mine]), len(norms))
                    found = np.flatnonzero(score >= bar.value[q])
                    s, d = np.append(best[q][0], score[found]), np.append(best[q][1], ids[found])
                    first = np.lexsort((d, -s))[:k]
                    best[q] = s[first], d[first]
        which = np.repeat(np.arange(n, dtype=np.int32), [len(x[0]) for x in best])
        yield pa.RecordBatch.from_arrays([pa.array(which), *(pa.array(np.concatenate([x[j] for x in best])) for j in (1, 0))], ["query", "doc", "score"])

    rows = index.blocks.mapInArrow(exact, "query int, doc long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return rows.withColumn("place", place).where(F.col("place") <= k)
