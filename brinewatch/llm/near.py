"""MinHash near-duplicate groups: bottom-k sketches of one hash, inverted lists, union-sketch estimates, exact Jaccard.

1. A document's set holds its distinct w-word shingles (with fewer words, the whole sequence as one). Equal sets are
   one class, so exact copies never meet as pairs.
2. Each class keeps its k smallest shingle hashes. Two sets at the threshold share s of these but for odds of 1e-10, so
   an inverted list needs only a class's k - s + 1 rarest values (rarest over all classes). Lists of equal members are one list.
3. A list goes to one task, or in blocks, each with the list's first class, to several. There every pair is estimated from the union of its two
   sketches; what may reach the threshold is joined, and only a spanning forest of it leaves the task, never all pairs.
   Classes of a longer list that are not connected with most of it by then meet all of it, block by block; the others need not meet each other.
4. The components of these forests are clusters: no link crosses them. Each cluster's whole sets meet in the same two
   passes, links are confirmed by exact Jaccard, and again only a forest leaves. Its components are the result.
   So a group of n near copies costs about n, not n * n.

Documents without words (null, empty, white space) have an empty set and are linked with nothing. Rows that repeat a
doc_id are treated by their texts; each row comes back. A row without doc_id is linked with nothing and kept. Empty tables give empty tables; further columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brinewatch.llm.components import components
from brinewatch.llm.tables import attached, dropped, saved, sorted_groups
from brinewatch.llm.words import mix, word_batches

BLOCK = 1024  # classes of a list in a task, and of a cluster
BLOCK_VALUES = 1_000_000  # shingles of a cluster's block
MARKS = 1 << 22  # bits that say which documents' texts are asked for
PART = 500  # texts whose sets a task holds at a time
FACTORS = np.array([pow(0x2545F4914F6CDD1D, i + 1, 1 << 64) for i in range(64)], np.uint64)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for ws in word_batches(column):
        bounds = ws.bounds()
        h = ws.hashes
        m = len(h) - width + 1
        sh = np.zeros(0, np.uint64)
        if m > 0:
            sh = h[:m] * FACTORS[0]
            for i in range(1, width):
                sh = sh + h[i : i + m] * FACTORS[i]
            sh = mix(sh)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if e - s >= width:
                yield np.unique(sh[s : e - width + 1])
            elif e > s:
                yield mix(np.add.reduce(h[s:e] * FACTORS[: e - s], keepdims=True) + np.uint64(0xABCDEF + e - s))
            else:
                yield np.zeros(0, np.uint64)


def _list_array(sets: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(sets) + 1, np.int32)
    np.cumsum([len(s) for s in sets], out=off[1:])
    flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))


def _class_of(s: np.ndarray) -> int:
    return int(mix(np.array([np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(s))], np.uint64)).view(np.int64)[0]) if len(s) else 0


def sketch_mapper(width: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PART):
                b = whole.slice(at, PART)
                sizes, nodes, sketches = [], [], []
                for s in shingle_sets(b.column("text"), width):
                    sizes.append(len(s))
                    nodes.append(_class_of(s))
                    sketches.append(s[:k].copy())  # the whole set goes
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), _list_array(sketches)], ["doc_id", "n_shingles", "node", "sketch"])

    return run


def least_shared(k: int, t: float, odds: float = 1e-10) -> int:
    """The largest s so that a pair at threshold t shares fewer than s of k union-sketch values with at most these odds."""
    total = 0.0
    for s in range(k + 1):
        total += math.comb(k, s) * t**s * (1 - t) ** (k - s)
        if total > odds:
            return s
    return k


class Forest:
    """Union-find over the rows of a task."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def overlaps(flat: np.ndarray, owner: np.ndarray, n: int, active: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each of n sets (of the active ones) in turn, how many values it shares with every set (by an inverted list of the values)."""
    order = np.argsort(flat, kind="stable")
    sorted_owner = owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[order][1:] != flat[order][:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(flat))
    group = np.empty(len(flat), np.int64)
    group[order] = np.cumsum(new) - 1
    bounds = np.searchsorted(owner, np.arange(n + 1))
    common = ends - starts > 1
    for a in range(n) if active is None else np.flatnonzero(active).tolist():
        g = group[bounds[a] : bounds[a + 1]]
        g = g[common[g]]
        if len(g):
            yield a, np.bincount(np.concatenate([sorted_owner[s:e] for s, e in zip(starts[g].tolist(), ends[g].tolist(), strict=True)]), minlength=n)


def _edges(nodes: np.ndarray, forest: Forest) -> pa.RecordBatch | None:
    roots = np.array([forest.find(i) for i in range(len(nodes))])
    keep = roots != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[roots[keep]])], ["a", "b"]) if keep.any() else None


def _ragged(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = t.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    return column.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(sizes)), sizes), sizes


def _asking(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A group's rows, one a node, and which of them are to meet all others: all in a first pass, the asking ones in a second."""
    node, asks = t.column("node").to_numpy(), t.column("asks").to_numpy().astype(bool)
    order = np.lexsort((~asks, node))  # by node, the asking row first
    first = np.append(True, np.diff(node[order]) != 0)
    if first.all():
        return t, asks
    return t.take(pa.array(order[first])), asks[order[first]]


def estimate_mapper(k: int, least: tuple[int, ...], num: int, den: int) -> Callable:
    """Within each (list, i, j): a forest of the pairs whose estimate may reach the threshold.

    A pair that shares an earlier list is estimated (or connected) there. Rows that hold the commonest earlier list need not meet each
    other, so only the rest go against all; in a large group, whose lists are nearly the same, that is a small part.
    """
    table = np.array(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["value", "i", "j"]):
            t, asks = _asking(t)
            nodes = t.column("node").to_numpy()
            size = t.column("n_shingles").to_numpy()
            flat, owner, sizes = _ragged(t, "sketch")
            n = len(nodes)
            whole = size <= k
            top = np.full(n, np.iinfo(np.uint64).max, np.uint64)
            last = np.cumsum(sizes) - 1
            top[~whole] = flat[last[~whole]]
            bounds = np.append(0, last + 1)
            met = np.zeros(n, bool)
            before, holder, _ = _ragged(t, "earlier")
            if len(before):
                lists, which, times = np.unique(before, return_inverse=True, return_counts=True)
                met[holder[which == times.argmax()]] = True
            if not asks.any() or met.all():
                continue
            forest = Forest(n)
            # a row that has met most others only asks those that have not
            for a, c in overlaps(flat, owner, n, asks if not asks.all() else ~met):
                others = np.flatnonzero(c)
                late = (others > a) | ~asks[others] | ((met[others] & ~met[a]) if asks.all() else False)
                others = others[late & ~(met[others] & met[a]) & (others != a) & (den * np.minimum(size[others], size[a]) >= num * np.maximum(size[others], size[a]))]
                if not len(others):
                    continue
                mine = np.searchsorted(flat[bounds[a] : bounds[a + 1]], np.minimum(top[others], top[a]), "right")
                theirs = np.array([np.searchsorted(flat[bounds[o] : bounds[o + 1]], top[a], "right") for o in others.tolist()]) if not whole[a] else sizes[others]
                both = c[others]
                union = mine + theirs - both
                sure = whole[others] & whole[a]
                ok = np.where(sure, den * both >= num * union, both >= table[np.minimum(union, len(table) - 1)])
                for o in others[ok].tolist():
                    forest.join(a, o)
            if (found := _edges(nodes, forest)) is not None:
                yield found

    return run


def confirm_mapper(num: int, den: int) -> Callable:
    """Within each (cluster, i, j): a forest of the links that whole sets confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["value", "i", "j"]):
            t, asks = _asking(t)  # rows repeated in the input are one class
            nodes = t.column("node").to_numpy()
            flat, owner, sizes = _ragged(t, "shingles")
            forest = Forest(len(nodes))
            for a, c in overlaps(flat, owner, len(nodes), asks):
                for o in np.flatnonzero(den * c >= num * (sizes + sizes[a] - c)).tolist():
                    forest.join(a, o)
            if (found := _edges(nodes, forest)) is not None:
                yield found

    return run


def set_mapper(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["value", "i", "j", "asks", "node"]
        for b in batches:
            for s in range(0, b.num_rows, 200):
                part = b.slice(s, 200)
                sets = list(shingle_sets(part.column("text"), width))
                own = [k for k, (x, node) in enumerate(zip(sets, part.column("node").to_pylist(), strict=True)) if _class_of(x) == node]  # a doc_id may come with other texts
                part = part.take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [_list_array([sets[k] for k in own])], [*names, "shingles"])

    return run


def _dealt(df: DataFrame, pairs: Column) -> DataFrame:
    """df once for each (i, j, asks) of its array of them."""
    return df.withColumn("_p", F.explode(pairs)).withColumns({c: F.col(f"_p.{c}") for c in ("i", "j", "asks")}).drop("_p")


def _pair(i: Column, j: Column, asks: bool) -> Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(asks).alias("asks"))


def first_pass(df: DataFrame) -> DataFrame:
    """df(value, node, blocks, lead) dealt to blocks by node; the lead, a group's first node, is in all of its blocks."""
    none = F.lit(-1)
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    return _dealt(df, F.when(F.col("node") == F.col("lead"), F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda i: _pair(i, none, True))).otherwise(F.array(_pair(own, none, True))))


def second_pass(df: DataFrame, pieces: DataFrame) -> DataFrame | None:
    """Rows of groups of several blocks that one piece doesn't hold: those outside a group's largest piece ask all of it, block by block.

    pieces is (node, component). Groups of one block, and those in one piece, have nothing left to compare; None if all are such.
    """
    rows = df.where("blocks > 1")
    if rows.isEmpty():
        return None
    sizes = rows.select("value", "node").join(pieces, "node", "left").groupBy("value", F.coalesce("component", "node").alias("piece")).agg(F.count("*").alias("n"))
    top = sizes.groupBy("value").agg(F.max(F.struct("n", "piece")).alias("top"), F.sum("n").alias("all")).where("top.n < all")
    top = saved(top.select("value", F.col("top.piece").alias("top"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("asking")), "pieces")
    if top.isEmpty():
        return None
    found = attached(rows, top, "value").where("asking is not null").join(pieces, "node", "left")
    own, mine = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64(F.lit(5), "node"), F.col("asking"))
    zero = F.lit(0).cast("bigint")
    asked = F.transform(F.sequence(zero, F.col("asking") - 1), lambda j: _pair(own, j, False))
    asks = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda i: _pair(i, mine, True))
    outside = F.coalesce("component", "node") != F.col("top")
    return _dealt(found, F.when(outside, F.concat(asked, asks)).otherwise(asked)).drop("component", "top", "asking")


def grouped(df: DataFrame, *columns: str) -> DataFrame:
    at = ["value", "i", "j"]
    return df.select(*at, "asks", "node", *columns).repartition(*at).sortWithinPartitions(*at)


def marked(docs: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """Rows of docs whose key may be among asked's: a bitmap of MARKS bits, of fixed size whatever the data, is set and broadcast as rows of 32 bits, so that most texts that
    nothing asks for are not shuffled. (Where more keys are asked than there are bits, more pass; none that is asked for goes.)"""
    bit = F.pmod(F.xxhash64(key), F.lit(MARKS))
    spot = {"_word": F.floor(bit / 32), "_at": F.pmod(bit, F.lit(32)).cast("int")}
    words = asked.select(key).distinct().withColumns(spot).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _at)")).alias("_bits"))  # MARKS / 32 rows at most
    return docs.withColumns(spot).join(F.broadcast(words), "_word").where("shiftright(_bits, _at) & 1 = 1").select(*docs.columns)


def two_passes(df: DataFrame, meet: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """(node, component) of the links that meet finds in groups of df(value, node, blocks, lead, ...) dealt to blocks."""
    pieces = components(meet(first_pass(df)), name)
    rest = second_pass(df, pieces)
    if rest is None:
        return pieces
    return components(meet(rest).unionAll(pieces.select(F.col("node").alias("a"), F.col("component").alias("b"))), f"{name}-all")


def near_groups(docs: DataFrame, width: int = 5, threshold: float = 0.8, k: int = 64) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n_shingles, component_id, kept), a row for each of docs.

    component_id is the smallest doc_id that links reach, kept whether it is the row's own. Texts are linked at a
    Jaccard similarity of their shingle sets of threshold or more.
    """
    share = Fraction(str(threshold)).limit_denominator(10_000)
    num, den = share.numerator, share.denominator
    s = least_shared(k, threshold)
    sketches = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch_mapper(width, k), "doc_id long, n_shingles long, node long, sketch array<long>")
    sketches = saved(sketches.withColumn("row", F.monotonically_increasing_id()), "sketches")
    words = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = saved(words.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.min("row").alias("row")), "classes")
    # any row of a class gives its sketch
    retained = saved(words.join(classes.select("row").hint("shuffle_hash"), "row", "left_semi").select("node", "n_shingles", "sketch"), "retained")
    listed = retained.select("node", "n_shingles", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    frequent = listed.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = listed.join(frequent, "value")
    rare = W.partitionBy("node").orderBy("df", "value")
    whole = F.floor(F.lit(k) * num / F.lit(den))  # up to this size, all partners within the threshold are whole in their sketches
    need = F.when(F.col("n_shingles") <= whole, F.ceil(F.col("n_shingles") * num / F.lit(den))).otherwise(F.lit(s))
    own = own.withColumn("at", F.row_number().over(rare) + F.col("k") - F.count("*").over(W.partitionBy("node")))
    own = saved(own.where(F.col("at") <= F.col("k") - need + 1).select("value", "node"), "lists")
    lists = own.groupBy("value").agg(F.count("*").alias("n"), F.min("node").alias("lead"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64(F.lit(7), "node").cast("decimal(38,0)")).alias("s2")).where("n > 1")
    lists = lists.groupBy("n", "lead", "s1", "s2").agg(F.min("value").alias("value")).select("value", "lead", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    held = own.join(lists, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("value", "blocks", "lead"))).alias("held"))  # k - s + 1 at most
    held = saved(held, "held")
    dropped(own)
    members = held.join(marked(retained, "node", held), "node").select("node", "n_shingles", "sketch", "held", F.posexplode("held").alias("at", "list"))
    members = members.select("node", "n_shingles", "sketch", F.slice("held.value", F.lit(1), F.col("at")).alias("earlier"), "list.*")
    least = tuple(least_shared(m, threshold, 1e-10) for m in range(2 * k + 1))
    estimated = lambda df: grouped(df, "n_shingles", "sketch", "earlier").mapInArrow(estimate_mapper(k, least, num, den), "a long, b long")
    clusters = two_passes(members, estimated, "loose").withColumnRenamed("component", "value")
    sizes = clusters.join(retained.select("node", "n_shingles"), "node").groupBy("value").agg(F.min("node").alias("lead"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_VALUES)).alias("blocks"))
    chosen = saved(clusters.join(classes, "node").join(sizes, "value").select(F.col("first_doc").alias("_id"), "node", "value", "blocks", "lead"), "chosen")
    dropped(held)
    dropped(retained)

    def confirmed(df: DataFrame) -> DataFrame:  # one doc_id of each class gives the whole set
        own = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
        texts = marked(own, "_id", df).join(df, "_id").select("value", "i", "j", "asks", "node", "text")
        sets = texts.mapInArrow(set_mapper(width), "value long, i int, j int, asks boolean, node long, shingles array<long>")
        return grouped(sets, "shingles").mapInArrow(confirm_mapper(num, den), "a long, b long")

    linked = two_passes(chosen, confirmed, "links")
    named = classes.join(linked, "node", "left").select("node", "first_doc", F.coalesce("component", "node").alias("component"))
    names = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = named.join(names, "component").select("node", "component_id")
    out = sketches.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
