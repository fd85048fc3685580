from __future__ import annotations

import re

import corpus_pipeline as cp
from brinewatch.llm import decision, queries
from brinewatch.llm.pii import redact

from test_near import brute
from test_rest import slow_statistics

SF = "/root/testdata/sf0.001"


def rejected(text, rules):
    """The base rules and a learned list, one text at a time."""
    words, chars, symbols, dup_lines, repeated = slow_statistics(text)
    if words < 10 or 100 * repeated > 20 * words:
        return True
    n = max(words, 1)
    of = {
        "symbols_a_word": symbols / n, "dup_lines": float(dup_lines), "repeated_share": repeated / n, "words": float(words), "word_length": chars / n,
        "capitals_a_word": len(re.findall("[A-Z]", text or "")) / n, "stops_a_word": len(re.findall("[!?]", text or "")) / n,
    }
    return any(all((of[x.measure] >= x.threshold) == x.above for x in rule) for rule in rules)


def test_stages_do_the_whole_job(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, None
    for k, (_, stage) in enumerate(cp.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == columns
        rows = out.collect()
        if k == 0:
            rules = [t.rule for t in decision.learned(docs, spark.read.parquet(f"{SF}/labels.parquet"))]
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before if not rejected(r.text, rules))
        if k == 1:
            groups = {i: c for i, _, c in brute([(r.doc_id, r.text) for r in before], 5, 4, 5)}
            assert sorted(r.doc_id for r in rows) == sorted(set(groups.values()))
        if k == 2:
            assert {r.doc_id: r.text for r in rows} == {r.doc_id: redact(r.text) for r in before}
        if k == 3:
            assert {r.doc_id for r in rows} == {r.doc_id for r in before} and len(rows) <= 2 * len(before)
        docs = spark.createDataFrame(rows, out.schema)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)


def test_every_operator_is_registered():
    assert [q.split("_")[0] for q in queries.queries()] == [f"op{n}" for n in range(1, 14)]


def test_awkward_rows_pass_all_stages(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_rows_that_repeat_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s"), (1, "a b c d e f", "de", "s"), (1, "u v w x y z", "en", "s"), (2, "a b c d e f", "en", "s"), (None, "a b c d e f", "en", "s")], "doc_id long, text string, lang string, source string")
    got = sorted(map(tuple, cp.near_duplicates(spark, docs, SF).collect()), key=repr)
    assert got == [(1, "a b c d e f", "de", "s"), (1, "u v w x y z", "en", "s"), (None, "a b c d e f", "en", "s")]
