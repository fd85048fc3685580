"""Importance resampling against a plain computation from spelled-out features."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from brinewatch.llm import queries, resample
from brinewatch.llm.words import SIGNS, word_batches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]


def plain(docs, target, buckets=10_000, share=25, least=20):
    def totals(texts):
        return collections.Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])

    s, t = totals(x for _, x in docs), totals(target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out, able = [], []
    for i, x in docs:
        w, f = features(x)
        weight = sum(gain[zlib.crc32(y.encode()) % buckets] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(w) >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[4] = k + 1
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_registered_query_equals_plain(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.op13_resample(spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and ordered(got.collect()) == ordered(plain(docs, target))


@pytest.mark.parametrize("share", [0, 25, 60, 100])
def test_awkward_rows(spark, awkward, share):
    target = [None, "", "the quick brown fox", "w5x3 w6x3 w7x3"]
    docs = awkward.withColumn("rank", resample.F.lit(1)).withColumn("_score", resample.F.lit("x"))
    got = resample.importance(docs, spark.createDataFrame([(t,) for t in target], "text string"), share=share, least=2, buckets=50)
    want = plain([(r.doc_id, r.text) for r in awkward.collect()], target, 50, share, 2)
    assert ordered(got.collect()) == ordered(want)
    kept = resample.resampled(awkward, spark.createDataFrame([(t,) for t in target], "text string"), share=share, least=2, buckets=50)
    assert kept.columns == awkward.columns
    drawn = {r[0] for r in want if r[4] is not None}
    assert {r.doc_id for r in kept.collect()} == drawn


def test_one_row_that_repeats(spark):
    rows = [(5, "a b c d")] * 400 + [(i, f"a b w{i} d") for i in range(10, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("a b c",)], "text string")
    got = resample.importance(docs, target, share=70, least=1)
    assert ordered(got.collect()) == ordered(plain(rows, ["a b c"], share=70, least=1))


def test_empty_tables(spark, awkward, nothing):
    none = spark.createDataFrame([], "text string")
    assert resample.importance(nothing, none).collect() == [] and resample.resampled(nothing, none).collect() == []
    assert ordered(resample.importance(awkward, none, least=1).collect()) == ordered(plain([(r.doc_id, r.text) for r in awkward.collect()], [], least=1))


@pytest.mark.parametrize("text", ["", "a", "a b a b a", "Élan vital; élan\nVITAL", "x" * 63 + " " + "y" * 64 + " " + "z" * 65 + " x" + " q" * 5, "1 2 3 10 20 1 2"])
def test_trie_states_are_checksums_of_spelled_features(text):
    buckets = 997
    want = np.zeros(buckets, np.int64)
    for f in features(text)[1]:
        want[zlib.crc32(f.encode()) % buckets] += 1
    got = np.zeros(buckets, np.int64)
    for w in word_batches(pa.array([text, None, ""]), resample.BLOCK, SIGNS):
        got += resample.Trie(w).totals(buckets)
    assert (got == want).all()
    gains = np.arange(buckets) - 300
    for w in word_batches(pa.array([text]), resample.BLOCK, SIGNS):
        assert resample.Trie(w).walked(gains).sum() == (want * gains).sum()
