"""Kneser-Ney: the model against counts of spelled-out n-grams, the sample's bound, thresholds of rare languages."""

from __future__ import annotations

import collections
import math
import random

import pytest

from brinewatch.llm import kneser

ORDER, START, END = 4, "<s>", "</s>"


def plain_model(texts):
    """log10 probability of a text by interpolated modified Kneser-Ney, from n-grams as tuples: raw counts at the top, distinct left extensions below."""
    padded = [[START] * (ORDER - 1) + list(t) + [END] for t in texts]
    top = collections.Counter(tuple(s[i - ORDER + 1 : i + 1]) for s in padded for i in range(ORDER - 1, len(s)))
    counts = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    uniform = 1 / (len(counts[1]) + 1)
    discounts, totals, masses = {}, {}, {}
    for n, c in counts.items():
        of = collections.Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5
        d = [1 - 2 * y * of[2] / of[1] if of[1] else 0.5, 2 - 3 * y * of[3] / of[2] if of[2] else 1.0, 3 - 4 * y * of[4] / of[3] if of[3] else 1.5]
        discounts[n] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        totals[n], masses[n] = collections.Counter(), collections.Counter()
        for g, k in c.items():
            totals[n][g[:-1]] += k
            masses[n][g[:-1]] += discounts[n][min(k, 3) - 1]

    def p(gram):
        n = len(gram)
        if not n:
            return uniform
        k, context = counts[n][gram], gram[:-1]
        if not totals[n][context]:
            return p(gram[1:])
        own = (k - discounts[n][min(k, 3) - 1]) / totals[n][context] if k else 0
        return own + masses[n][context] / totals[n][context] * p(gram[1:])

    def log_probability(text):
        s = [START] * (ORDER - 1) + list(text) + [END]
        return sum(math.log10(p(tuple(s[i - ORDER + 1 : i + 1]))) for i in range(ORDER - 1, len(s)))

    return log_probability


@pytest.mark.parametrize("seed", range(3))
def test_the_model_equals_plain_counts(spark, seed):
    draw = random.Random(seed)
    words = ["the", "then", "rather", "Straße", "été", "б", "a", "ab", "", " "]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 30))) for _ in range(60)] + ["", "x", "the then"] * 2
    want = plain_model(texts)
    model = kneser.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    asked = ["", "the", "rather then", "never seen: qqq", "ß" * 10, *texts[:10], "été б ab"]
    assert kneser.log_probabilities(model, asked).tolist() == pytest.approx([want(t) for t in asked], rel=1e-9)


def test_the_sample_is_bounded_in_characters(spark):
    docs = spark.createDataFrame([(i, "ab cd " * 20 if i else "long " * 5000, "en") for i in range(200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    seen = []
    fit = kneser.fit
    try:
        kneser.fit = lambda texts: (seen.append(texts.selectExpr("sum(length(text) + 1) AS n", "max(length(text)) AS m").first()), fit(texts))[1]
        rows = kneser.perplexities(docs, labels, chars=6000).collect()
    finally:
        kneser.fit = fit
    assert 2000 < seen[0].n <= 6000 and seen[0].m == 120 and len(rows) == 200 and not next(r for r in rows if r.doc_id == 0).kept


def test_a_rare_language_has_its_own_threshold(spark):
    random.seed(9)
    texts = [("en", " ".join(random.choice(("the", "then", "rather", "other")) for _ in range(50))) for _ in range(2000)]
    texts += [("xx", "".join(random.choice("бвгджзклмн ") for _ in range(200))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    got = kneser.perplexities(docs, labels, sample=400).collect()
    limits = {r.lang: r.threshold for r in got}
    assert limits["xx"] > 1.5 * limits["en"]
    small = {r.lang: r.threshold for r in kneser.perplexities(docs, labels).collect()}  # all are in the sample: few of xx are held back
    assert small["xx"] > 1.5 * small["en"]
    assert sum(r.kept for r in got if r.lang == "xx") == 120


def test_two_texts_of_a_language_keep_their_centre(spark):
    draw = random.Random(5)
    texts = [("en", " ".join(draw.choice(("the", "then", "rather", "other")) for _ in range(50))) for _ in range(600)]
    texts += [("yy", "".join(draw.choice("бвгджзклмн ") for _ in range(200))) for _ in range(2)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    got = kneser.perplexities(docs, labels, sample=100).collect()
    assert len({r.threshold for r in got}) == 2 and all(r.kept for r in got if r.lang == "yy")


def test_the_model_learns_from_all_trusted_texts(spark):
    docs = spark.range(25_000).selectExpr("id AS doc_id", "concat('w', id % 7) AS text", "'en' AS lang")
    labels = spark.range(25_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    seen = []
    fit = kneser.fit
    try:
        kneser.fit = lambda texts: (seen.append(texts.count()), fit(texts))[1]
        kneser.perplexities(docs, labels)
    finally:
        kneser.fit = fit
    assert seen[0] == docs.selectExpr("count_if(pmod(xxhash64(doc_id, 3), 5) != 0) AS n").first().n


def test_large_tables_stay_distributed_with_the_same_result(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("abcde é\U0001f600") for _ in range(draw.randrange(0, 40))) for _ in range(300)] + ["", None, "abab", "abab"]
    docs = spark.createDataFrame([(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts)] + [(5, "zz", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    shared, joined = (sorted(kneser.perplexities(docs, labels, most=m).collect(), key=lambda r: (r.doc_id, r.n_chars)) for m in (kneser.TABLE, 0))
    assert len(shared) == len(joined) == len(texts) + 1
    for a, b in zip(shared, joined, strict=True):
        assert a[:3] == b[:3] and a.kept == b.kept and a[3:5] == pytest.approx(b[3:5], rel=1e-9)
