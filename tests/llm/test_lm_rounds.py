"""Training sums: they don't hang on how texts are dealt, gradients are those of the loss, and rounds make held-out texts likelier."""

from __future__ import annotations

import numpy as np

from brinewatch.llm import lm


def test_scores_do_not_hang_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, many = ({r.doc_id: r for r in lm.text_scores(docs.repartition(n)).collect()} for n in (2, 20))
    assert one.keys() == many.keys()
    for i, r in one.items():
        assert abs(r.score - many[i].score) <= 1e-4 * r.n_tokens and r.base_score == many[i].base_score or abs(r.base_score - many[i].base_score) < 1e-9 * r.n_tokens


def test_gradient_is_the_loss_s(monkeypatch):
    monkeypatch.setattr(lm, "FEATURES", 32)
    rng = np.random.default_rng(3)
    f, leaf = rng.integers(0, 32, (200, lm.KINDS)).astype(np.int32), rng.integers(0, lm.LEAVES, 200)
    counts = np.bincount(leaf, minlength=lm.LEAVES)
    w = rng.normal(0, 0.3, 32 * (lm.GROUPS + lm.LEAVES)).astype(np.float32)
    g = lm.Model(counts, w.copy()).gradient(f, leaf)

    def loss(at, d):
        v = w.astype(np.float64)
        v[at] += d
        return -lm.Model(counts, v).log10(f, leaf).sum() * np.log(10)

    for at in rng.choice(len(w), 40, replace=False):
        assert abs((loss(at, 1e-3) - loss(at, -1e-3)) / 2e-3 - g[at]) < 2e-2


def test_rounds_help_on_held_out_texts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    gained = []
    for rounds in (0, 4):
        monkeypatch.setattr(lm, "ROUNDS", rounds or 1)
        if not rounds:
            monkeypatch.setattr(lm, "RATE", 0.0)
        else:
            monkeypatch.setattr(lm, "RATE", 0.25)
        rows = lm.text_scores(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
        gained.append((rows.s - rows.b) / rows.n)
    assert gained[1] > gained[0] > 0.05
    print(gained)
