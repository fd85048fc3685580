"""Scores of whole texts under a hashed maximum-entropy model, beside a smoothed unigram base.

Tokens are a text's words (A-Z lower-cased) and one end. A token's leaf is one of 64: the end, each of the 47 most
frequent words, or one of 16 shares of all other words by their last letters. The model is P(leaf's group | history) *
P(leaf | group, history) * P(word | leaf): two softmaxes of eight outcomes over hashed features (previous word, previous
two, and the words two and three back), then the word's smoothed share of its leaf. Groups are the classes of the factored softmax.

Training: one pass counts each feature with each leaf, which gives first weights (smoothed logarithms of how much likelier an outcome is with the
feature, shrunk as four features speak at once). ROUNDS gradient updates follow, each over another part of all training texts: tasks return the sum of their
tokens' gradients under weights broadcast to all, the sums are added chunk by chunk in Spark, and the driver takes one step, scaled by how often a
feature occurs. So the result does not hang on how rows are dealt to tasks (but for rounding). Weights have a fixed size
(FEATURES * 72 floats, 4.7 MB), so they may be broadcast. Word counts never leave Spark: a block of about 8 MB of texts asks for its
distinct words in one join and scores its texts with what comes back.

Null text is empty: one token, the end. Texts of any length work. A null doc_id counts as held out (its text is "").
Rows that repeat are scored and counted each. An empty table, or one without training rows, gives N = V = 0 and
finite scores. Further columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from brinewatch.llm.tables import saved
from brinewatch.llm.words import LOWER, Words, mix, word_batches

FEATURES = 1 << 14
GROUPS = 8
LEAVES = 64
SHARED = 16  # leaves of words that have none of their own
KINDS = 4
BATCH = 16_384
STEP_TOKENS = 1 << 18
ROUNDS = 4
SHRUNK = 0.5
SMOOTH = 30.0
RATE = 0.25
DAMPED = 10.0
BLOCK_BYTES = 8 << 20
CHUNKS = 32
END = np.uint64(0x1F83D9ABFB41BD6B)
START = np.uint64(0x5BE0CD19137E2179)
SEEDS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def shared_leaf(ws: Words) -> np.ndarray:
    """The leaf by a word's last two letters, for every word."""
    last = ws.ends - 1
    for _ in range(3):
        last = np.where(~LETTER[LOWER[ws.data[last]]] & (last > ws.starts), last - 1, last)
    a = LOWER[ws.data[last]].astype(np.uint64)
    b = np.where(last > ws.starts, LOWER[ws.data[np.maximum(last - 1, 0)]], 0).astype(np.uint64)
    return (LEAVES - SHARED + (mix(a + (b << np.uint64(8)) + np.uint64(1)) % np.uint64(SHARED)).astype(np.int64)).astype(np.int64)


def tokens(ws: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens with each text's end put in, where each text begins (and the end), and shared leaves."""
    bounds = ws.bounds()
    starts = bounds + np.arange(ws.n + 1)
    at = np.arange(len(ws.hashes)) + (ws.doc - ws.first)
    h = np.full(len(ws.hashes) + ws.n, END, np.uint64)
    h[at] = ws.hashes
    leaf = np.zeros(len(h), np.int64)
    leaf[at] = shared_leaf(ws)
    return h, starts, leaf


class Leaves:
    """Which words have leaves of their own; leaf 0 is the end."""

    def __init__(self, top: list[int]) -> None:
        own = np.array(top, np.int64).view(np.uint64)
        order = np.argsort(own)
        self.words, self.leaf = own[order], (np.arange(len(own)) + 1)[order]

    def of(self, h: np.ndarray, shared: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return shared
        k = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[k] == h, self.leaf[k], shared)


def features(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of KINDS feature numbers for each token; histories end at a text's start."""
    back = []
    place = np.arange(len(h)) - np.repeat(starts[:-1], np.diff(starts))
    for d in (1, 2, 3):
        x = np.full(len(h), START, np.uint64)
        x[d:] = h[:-d]
        x[place < d] = START
        back.append(x)
    one, two, three = back
    rows = [one * SEEDS[0], one * SEEDS[1] + two * SEEDS[2], two * SEEDS[3], three * SEEDS[4]]
    return np.stack([(mix(x) & np.uint64(FEATURES - 1)).astype(np.int32) for x in rows], 1)


class Model:
    """Weights w1[feature, group] and w2[feature, group, leaf in it], and biases from the leaves' counts."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray | None = None) -> None:
        share = np.asarray(counts, float) + 0.5
        share = (share / share.sum()).reshape(LEAVES // GROUPS, GROUPS).T  # leaf = place * GROUPS + group
        self.b1 = np.log(share.sum(1)).astype(np.float32)
        self.b2 = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
        self.weights = np.zeros(FEATURES * (GROUPS + LEAVES), np.float32) if weights is None else weights
        self.w1 = self.weights[: FEATURES * GROUPS].reshape(FEATURES, GROUPS)
        self.w2 = self.weights[FEATURES * GROUPS :].reshape(FEATURES * GROUPS, LEAVES // GROUPS)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def forward(self, f: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        group, place = leaf % GROUPS, leaf // GROUPS
        z1, z2 = self.b1 + np.zeros((len(f), 1), np.float32), self.b2[group]
        for k in range(KINDS):
            z1 += self.w1.take(f[:, k], 0)
            z2 += self.w2.take(f[:, k] * GROUPS + group, 0)
        return self._softmax(z1), self._softmax(z2), group, place

    def log10(self, f: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        p1, p2, group, place = self.forward(f, leaf)
        n = np.arange(len(f))
        return np.log10(np.maximum(p1[n, group].astype(float), 1e-30)) + np.log10(np.maximum(p2[n, place].astype(float), 1e-30))

    def gradient(self, f: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """The sum of the tokens' gradients, in the order of the weights."""
        p1, p2, group, place = self.forward(f, leaf)
        n = np.arange(len(f))
        p1[n, group] -= 1
        p2[n, place] -= 1
        g1, g2 = np.zeros(self.w1.T.shape), np.zeros(self.w2.T.shape)  # an outcome a row, so that each sum is contiguous
        for p, g, at in ((p1, g1, f), (p2, g2, f * GROUPS + group[:, None].astype(np.int32))):
            for j in range(len(g)):
                column = p[:, j].astype(float)
                for k in range(KINDS):
                    g[j] += np.bincount(at[:, k], column, g.shape[1])
        return np.concatenate([g1.T.ravel(), g2.T.ravel()])


class Counts:
    """How often each feature occurs with each leaf, and what follows from it: first weights, and each weight's curvature."""

    def __init__(self, leaves: np.ndarray, pairs: np.ndarray) -> None:
        share = np.asarray(leaves, float) + 0.5
        share = (share / share.sum()).reshape(LEAVES // GROUPS, GROUPS).T
        self.leaves, self.group = np.asarray(leaves, float), share.sum(1)
        self.within = share / share.sum(1, keepdims=True)
        self.n2 = pairs.reshape(FEATURES, LEAVES // GROUPS, GROUPS).transpose(0, 2, 1)  # leaf = place * GROUPS + group
        self.n1 = self.n2.sum(2)

    def weights(self) -> np.ndarray:
        n0 = self.n1.sum(1, keepdims=True)
        w1 = np.log((self.n1 + SMOOTH * self.group) / (n0 + SMOOTH)) - np.log(self.group)
        w2 = np.log((self.n2 + SMOOTH * self.within) / (self.n1[:, :, None] + SMOOTH)) - np.log(self.within)
        return (SHRUNK * np.concatenate([w1.ravel(), w2.ravel()])).astype(np.float32)

    def curvature(self, share: float) -> np.ndarray:
        """About the second derivative of a share of all tokens' loss, damped."""
        c1 = self.n1.sum(1, keepdims=True) * (self.group * (1 - self.group))
        c2 = self.n1[:, :, None] * (self.within * (1 - self.within))
        return share * np.concatenate([c1.ravel(), c2.ravel()]) + DAMPED


def _unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(h, return_index=True, return_inverse=True, return_counts=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held = np.array([is_held_out(i) for i in b.column("doc_id").to_pylist()], bool)
        for ws in word_batches(b.column("text"), BLOCK_BYTES):
            h, starts, leaf = tokens(ws)
            train = np.repeat(~held[ws.first : ws.first + ws.n], np.diff(starts))
            u, first, _, c = _unique(h[train])
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64)), pa.array(leaf[train][first].astype(np.int32))], ["word", "c", "leaf"])


def _chunked(total: np.ndarray) -> pa.RecordBatch:
    parts = np.array_split(total.astype(np.float32), CHUNKS)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "x"])


def sum_mapper(top: list[int], size: int, add: Callable) -> Callable:
    """One sum a task, in chunks, over its training tokens, about STEP_TOKENS at a time: of what add() gives for their features and leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, total, each = Leaves(top), np.zeros(size), add()
        held_f, held_leaf, n = [], [], 0

        def flush() -> None:
            nonlocal n
            if n:
                np.add(total, each(np.concatenate(held_f), np.concatenate(held_leaf)), out=total)
            held_f.clear()
            held_leaf.clear()
            n = 0

        for b in batches:
            held = np.array([is_held_out(i) for i in b.column("doc_id").to_pylist()], bool)
            for ws in word_batches(b.column("text")):
                h, starts, shared = tokens(ws)
                train = np.repeat(~held[ws.first : ws.first + ws.n], np.diff(starts))
                f, leaf = features(h, starts)[train], leaves.of(h, shared)[train]
                for s in range(0, len(f), STEP_TOKENS):
                    held_f.append(f[s : s + STEP_TOKENS])
                    held_leaf.append(leaf[s : s + STEP_TOKENS])
                    n += len(held_f[-1])
                    if n >= STEP_TOKENS:
                        flush()
        flush()
        yield _chunked(total)

    return run


def pair_counts() -> Callable:
    def add(f: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        at = (f.astype(np.int64) * LEAVES + leaf[:, None]).ravel()
        return np.bincount(at, minlength=FEATURES * LEAVES)

    return add


def gradients(counts: np.ndarray, weights) -> Callable:
    def make() -> Callable:
        return Model(counts, weights.value).gradient

    return make


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column("chunk").to_pylist(), b.column("x").to_pylist(), strict=True):
            x = np.frombuffer(x, np.float32).astype(float)
            total[k] = total[k] + x if k in total else x
    for k, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["chunk", "x"])


def summed(docs: DataFrame, mapper: Callable, size: int) -> np.ndarray:
    """The sum over all tasks, of which there are no more than two a core: each returns as much, whatever it read. CHUNKS rows come to the driver, 10 MB at most."""
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    rows = docs.coalesce(tasks).mapInArrow(mapper, "chunk int, x binary").repartition("chunk").mapInArrow(_sum_chunks, "chunk int, x binary").collect()
    parts = {r.chunk: np.frombuffer(r.x) for r in rows}
    return np.concatenate([parts[k] for k in range(CHUNKS)]) if parts else np.zeros(size)


def trained(docs: DataFrame, top: list[int], leaves: np.ndarray) -> np.ndarray:
    """Weights from docs(doc_id, text), whose held-out rows are left out."""
    counts = Counts(leaves, summed(docs, sum_mapper(top, FEATURES * LEAVES, pair_counts), FEATURES * LEAVES))
    weights = counts.weights()
    curvature = counts.curvature(1 / ROUNDS)
    for k in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast(weights)
        part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(ROUNDS)) == k)
        weights = (weights - RATE * summed(part, sum_mapper(top, len(weights), gradients(leaves, shared)), len(weights)) / curvature).astype(np.float32)
        shared.destroy()
    return weights


FAR = 0xFFFF


def packed(numbers: np.ndarray) -> bytes:
    """Two bytes a number; those from FAR on follow in four."""
    return np.minimum(numbers, FAR).astype("<u2").tobytes() + numbers[numbers >= FAR].astype("<i4").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, "<u2", n).astype(np.int64)
    out[out == FAR] = np.frombuffer(data, "<i4", -1, 2 * n)
    return out


def score_mapper(top: list[int], counts: np.ndarray, weights) -> Callable:
    """Per text the model's part that needs no counts, and which of its block's words its tokens are; per block its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, model = Leaves(top), Model(counts, weights.value)
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for ws in word_batches(b.column("text"), BLOCK_BYTES):
                h, starts, shared = tokens(ws)
                leaf = leaves.of(h, shared)
                u, first, where, often = _unique(h)
                order = np.argsort(-often, kind="stable")  # frequent words have small numbers
                rank = np.empty(len(u), np.int32)
                rank[order] = np.arange(len(u), dtype=np.int32)
                u, first, where = u[order], first[order], rank[where]
                lp = np.zeros(len(h))
                for s in range(0, len(h), 8 * BATCH):  # features of a piece need the three tokens before it
                    e, k = min(len(h), s + 8 * BATCH), max(0, s - 3)
                    inner = np.clip(starts, k, e) - k
                    lp[s:e] = model.log10(features(h[k:e], np.unique(np.append(inner, [0, e - k])))[s - k :], leaf[s:e])
                sums = np.add.reduceat(lp, starts[:-1])
                own = [ids[d] for d in range(ws.first, ws.first + ws.n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * ws.n, pa.int64()), pa.array(own, pa.int64()), pa.array([is_held_out(i) for i in own]), pa.array(np.diff(starts).astype(np.int64)), pa.array(sums), pa.array([packed(where[s:e]) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary()), pa.nulls(ws.n, pa.list_(pa.int64())), pa.nulls(ws.n, pa.list_(pa.int32()))],
                    ["block", "doc_id", "held_out", "n_tokens", "leaf_score", "at", "words", "leaves"],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.binary()), pa.array([u.view(np.int64)], pa.list_(pa.int64())), pa.array([leaf[first].astype(np.int32)], pa.list_(pa.int32()))],
                    ["block", "doc_id", "held_out", "n_tokens", "leaf_score", "at", "words", "leaves"],
                )
                block += 1

    return run


def finish(total: int, distinct: int, leaf_total: np.ndarray, leaf_distinct: np.ndarray) -> Callable:
    def run(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        words = words.sort_values("pos")
        c, leaf = words["c"].to_numpy(float), words["leaf"].to_numpy()
        base = np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
        own = leaf < LEAVES - SHARED
        within = np.where(own, 0.0, np.log10((c + 0.1) / (leaf_total[leaf] + 0.1 * (leaf_distinct[leaf] + 1))))
        out = {"n_known": [], "base_score": [], "score": []}
        for lp, at, n in zip(texts["leaf_score"], texts["at"], texts["n_tokens"], strict=True):
            k = unpacked(at, n)
            out["n_known"].append(int((c[k] > 0).sum()))
            out["base_score"].append(float(base[k].sum()))
            out["score"].append(float(lp + within[k].sum()))
        return texts[["doc_id", "held_out", "n_tokens"]].assign(train_tokens=total, **out)[["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]]

    return run


def text_scores(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each of docs.

    Trained on the rows whose crc32(doc_id as text) mod 10 is not 0.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocabulary = saved(docs.mapInArrow(_count, "word long, c long, leaf int").groupBy("word").agg(F.sum("c").alias("c"), F.max("leaf").alias("leaf")), "vocabulary")
    end = int(END.view(np.int64))
    top = [r.word for r in vocabulary.where(F.col("word") != end).orderBy(F.desc("c"), "word").limit(LEAVES - SHARED - 1).collect()]
    own = F.create_map(*[F.lit(x) for k, w in enumerate([end, *top]) for x in (w, k)])
    stats = vocabulary.groupBy(F.coalesce(F.try_element_at(own, "word"), "leaf").alias("leaf")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    counts, distinct = np.zeros(LEAVES), np.zeros(LEAVES)
    for r in stats:
        counts[r.leaf], distinct[r.leaf] = r.c, r.v
    weights = trained(docs, top, counts)
    schema = "block long, doc_id long, held_out boolean, n_tokens long, leaf_score double, at binary, words array<long>, leaves array<int>"
    scored = saved(docs.mapInArrow(score_mapper(top, counts, spark.sparkContext.broadcast(weights)), schema), "scored")
    asked = scored.where("words is not null").select("block", F.posexplode(F.arrays_zip("words", "leaves")).alias("pos", "w")).select("block", "pos", F.col("w.words").alias("word"), F.col("w.leaves").alias("leaf"))
    found = asked.join(vocabulary.select("word", "c"), "word", "left").select(F.col("block").alias("asked_by"), "pos", F.coalesce("c", F.lit(0)).alias("c"), "leaf")
    texts = scored.where("words is null").drop("words", "leaves")
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("block").cogroup(found.groupBy("asked_by")).applyInPandas(finish(int(counts.sum()), int(distinct.sum()), counts, distinct), result)
