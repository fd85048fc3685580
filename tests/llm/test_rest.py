"""Language model, quality, media, URLs, mixing, pieces and pages."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brinewatch.llm import decision, html, kneser, lm, media, mixing, pieces, urls, words
from brinewatch.llm.queries import PIECES, URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


# words


def test_words_are_those_of_the_pattern():
    texts = ["", None, " a\x0bB\t", "x" * 3000, "é É\n\n\nÉ", "one", "  lead", "trail  ", "ab cd " * 200_000]
    found = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    hashes = {}
    for size in (1, 50, 1 << 20):
        got = [[] for _ in texts]
        for ws in words.word_batches(pa.array(texts), size):
            for h, d, s, e in zip(ws.hashes.tolist(), ws.doc.tolist(), ws.starts.tolist(), ws.ends.tolist(), strict=True):
                w = bytes(ws.data[s:e]).decode().translate(LOWER)
                assert hashes.setdefault(w, h) == h
                got[d].append(w)
        assert got == found
    assert len(set(hashes.values())) == len(hashes)


# language model


@pytest.fixture(scope="module")
def corpus(spark):
    random.seed(3)
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = []
    for i in range(800):
        pool = a if i % 2 else b
        rows.append((i, " ".join(random.choice(pool[: 1 + random.randrange(40)]) for _ in range(40))))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_base_scores_match_and_the_model_beats_them_on_held_out_texts(corpus):
    rows = corpus.collect()
    tokens = {r.doc_id: [*WORD.findall(r.text.translate(LOWER)), "<end>"] for r in rows}
    c = collections.Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 10 for t in ts)
    n, v = sum(c.values()), len(c)
    got = lm.text_scores(corpus).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) and r.train_tokens == n and r.n_tokens == len(tokens[r.doc_id])
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens[r.doc_id]), rel_tol=1e-9)
        assert r.n_known == sum(c[t] > 0 for t in tokens[r.doc_id])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_leaf_probabilities_sum_to_one():
    model = lm.Model(np.arange(64.0))
    random_weights = np.random.default_rng(1).normal(size=model.weights.shape).astype(np.float32)
    model = lm.Model(np.arange(64.0), random_weights)
    f = np.repeat(np.array([[5, 77, 900, 3]], np.int32), 64, 0)
    assert math.isclose((10 ** model.log10(f, np.arange(64))).sum(), 1, rel_tol=1e-5)


def test_scores_of_awkward_rows(awkward, nothing):
    got = {r.doc_id: r for r in lm.text_scores(awkward).collect()}
    assert got[4].n_tokens == got[5].n_tokens == got[6].n_tokens == 1
    assert got[None].held_out and all(math.isfinite(r.score) for r in got.values())
    assert lm.text_scores(awkward).count() == awkward.count()
    assert lm.text_scores(nothing).collect() == []


# decision lists


def slow_statistics(t):
    w = WORD.findall(t or "")
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, awkward):
    random.seed(4)
    texts = ["".join(random.choice(["a ", "b ", "c\n", "#", "\t", "é ", "a b c d e ", "\x0b"]) for _ in range(random.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionAll(awkward.select("doc_id", "text"))
    for r in df.select("text", decision.statistics(F.col("text")).alias("s")).collect():
        assert tuple(r.s)[:5] == slow_statistics(r.text)


def test_rules_are_learned_and_keep_good_rows(spark):
    random.seed(6)
    rows = [(i, i % 3 > 0, "".join(random.choice(["alpha ", "beta ", "gamma ", "delta "] if i % 3 else ["alpha### ", "beta$$$ "]) for _ in range(40))) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g)) for i, g, _ in rows if i % 2] + [(None, 0), (1, None)], "doc_id long, quality int")
    rules = decision.learned(docs, labels)
    assert rules and "symbols" in str(rules[0].rule[0]) and rules[0].bad >= decision.LEAST and not rules[0].good
    got = decision.judged(docs, labels).collect()
    assert {(r.doc_id % 3 > 0) for r in got if r._rule is None} == {True} and len(got) == 900


def test_without_labels_only_base_rules(spark, awkward, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in decision.judged(awkward, labels).collect()}
    assert got[1]._kept and not got[4]._kept and not got[7]._kept and got[1]._rule is None
    assert decision.judged(nothing, labels).collect() == []


# Kneser-Ney


def test_probabilities_sum_to_one_and_junk_is_surprising(spark):
    texts = ["abab abba baba", "aabb abab", "", "bab aba"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = kneser.fit(df)
    probs, backs, uniform = model
    symbols = sorted({*"".join(texts)})

    def p(history, c):
        """By the definition, from the tables."""
        out = uniform
        h = [kneser.START] * 3 + [ord(x) for x in history]
        for n in range(1, 5):
            g = np.array([*h[len(h) - n + 1 :], c], np.uint32)
            key = kneser.grams(g, n)
            ctx = kneser.grams(g[:-1], n - 1) if n > 1 else np.zeros(1, np.uint64)
            own = kneser._find(probs[n - 1], key, -1.0)[0]
            out = own if own >= 0 else kneser._find(backs[n - 1], ctx, 1.0)[0] * out
        return out

    for history in ("", "a", "ab", "abab", "ab "):
        total = sum(p(history, ord(c)) for c in symbols) + p(history, kneser.END) + p(history, 0x2603)
        assert math.isclose(total, 1, abs_tol=1e-6), (history, total)
    lp = kneser.log_probabilities(model, ["abab", ""])
    assert math.isclose(lp[0], sum(math.log10(p("abab"[:i], ord(c))) for i, c in enumerate("abab")) + math.log10(p("abab", kneser.END)), rel_tol=1e-9)
    assert math.isclose(lp[1], math.log10(p("", kneser.END)), rel_tol=1e-9)


def test_perplexity_separates_held_out_junk(spark, nothing):
    random.seed(8)
    clean = [" ".join(random.choice(["the", "then", "rather", "heather", "other"]) for _ in range(60)) for _ in range(500)]
    junk = ["".join(random.choice("#$%&XQ7") for _ in range(200)) for _ in range(60)]
    rows = [(i, t, "en", "a", 1, "x") for i, t in enumerate(clean + junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 500, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser.perplexities(docs, labels).collect()}
    assert not any(got[i].kept for i in range(500, 560))
    assert sum(got[i].kept for i in range(1, 500, 2)) >= 245
    none = labels.where("doc_id < 0")
    assert {r.kept for r in kneser.perplexities(docs, none).collect()} == {True}
    assert kneser.perplexities(nothing, labels).collect() == []


# media


def test_payload_round_trip(awkward, nothing):
    got = {r.doc_id: r for r in media.media_columns(awkward).collect()}
    for r in awkward.collect():
        raw = (r.text or "").encode()
        m = got[r.doc_id]
        assert m.n_bytes == len(raw) and bytes(m.payload)[: len(raw)] == raw and len(m.payload) % 64 == 0 and len(m.payload) >= 64
        assert media.from_wav(bytes(m.media)) == bytes(m.payload)
    digest = {r.doc_id: r for r in media.media_columns(awkward, digest=True).collect()}
    assert digest[1].feature == digest[2].feature and digest[1].feature != digest[3].feature
    assert digest[9].payload_sha256 == hashlib.sha256(bytes(got[9].payload)).hexdigest() and digest[9].tail_crc32 == zlib.crc32(bytes(got[9].payload)[-64:])
    assert digest[4].n_pairs == 0
    assert media.media_columns(nothing).collect() == []


def test_peaks_find_a_tone():
    t = np.arange(128 * 6)
    wave = (128 + 90 * np.sin(2 * np.pi * 32 * t / 128)).astype(np.uint8)
    p = media.peaks(wave.tobytes())
    assert set(p[:, 0].tolist()) == {32}
    codes = media.pairs(p[:, :1].repeat(2, 1))
    assert all(c & 255 in (1, 2, 3) and c >> 16 & 255 == 32 for c in codes.tolist())


# URLs


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("https://Blog.X.example.COM/en/853/?a#b", "blog.x.example.com", "/en/853/", "com/en/"),
        ("http://a.example.com/en/728", "a.example.com", "/en/728", "example.com/en/7"),
        ("http://notexample.com/en/728", "notexample.com", "/en/728", "com/en/"),
        ("http://x.example.net/de/85?q", "x.example.net", "/de/85", "example.net/de/8"),
        ("http://net/de/1", "net", "/de/1", "net/de/"),
        ("http://x.org/es", "x.org", "/es", None),
        ("ftp://h?x/y", "h", "", None),
        ("no scheme", "", "", None),
        ("://", "", "", None),
        (None, "", "", None),
        ("", "", "", None),
    ],
)
def test_listed_rules(spark, url, host, path, rule):
    labelled = spark.createDataFrame([], "url string, bad boolean")
    r = urls.judged(spark.createDataFrame([(url,)], "url string"), URL_RULES, labelled).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, URL_RULES.get(rule, "allow"))


def test_mined_rules_block_what_labels_show(spark):
    rows = [(f"http://{h}.example.fr/{p}/{i}", h == "spam" and p == "win") for i in range(60) for h in ("spam", "good", "fine") for p in ("win", "news")]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    known = labelled.select("bad", urls.tokens(*urls.parts_of(F.col("url"))).alias("tokens"), F.expr("substring(md5(url), 1, 1) < '5'").alias("held"))
    assert [sorted(r.rule) for r in urls.mined(known)[0].collect()] == [["host:spam", "path:win"]]
    pages = spark.createDataFrame([("http://spam.example.fr/win/9",), ("http://spam.example.fr/news/9",), ("http://spam.example.fr/win/9",), (None,)], "url string")
    assert sorted(r.verdict for r in urls.judged(pages, URL_RULES, labelled).collect()) == ["allow", "allow", "block", "block"]
    # six rows are too few, whatever they say; and columns of the same names as ours are replaced, others stay
    few = labelled.limit(6).withColumn("bad", F.lit(True))
    clash = pages.selectExpr("url", "1 as tokens", "2 as rule", "3 as _row")
    got = urls.judged(clash, URL_RULES, few)
    assert got.columns == ["url", "tokens", "_row", *urls.ADDED] and {r.verdict for r in got.collect()} == {"allow"}
    long = spark.createDataFrame([("http://h.fr/" + "a/" * 200_000,)], "url string")
    assert urls.judged(long, URL_RULES, labelled).first().verdict == "allow" and urls.judged(pages.limit(0), URL_RULES, labelled).collect() == []


# mixing


def sources(spark):
    rows = [(i, f"s{0 if i < 700 else 1 if i < 900 else 2}", "w " * (i % 50), 1) for i in range(1000)] + [(None, None, None, None)] * 3
    return spark.createDataFrame(rows, "doc_id long, source string, text string, extra int")


def test_nothing_is_dropped_within_the_repetition_limit(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 64)
    docs = sources(spark)
    got = mixing.mixed(docs, repetition=3.0).collect()
    times = collections.Counter(r.doc_id for r in got)
    assert set(times) == {None, *range(1000)}
    # the smallest source, the three rows without one, is passed through three times
    assert times.pop(None) == 3 * 3 and max(times.values()) <= 3
    drawn = collections.Counter()
    for r in got:
        drawn[r.source] += r._tokens
    total = collections.Counter()
    for r in docs.collect():
        total[r.source] += len((r.text or "").split()) + 1
    weights = {r.source: r._weight for r in got}
    assert math.isclose(sum(weights.values()), 1, abs_tol=1e-9)
    budget = total["s0"] / weights["s0"]
    for s in total:  # to within the document that is cut
        assert abs(drawn[s] - weights[s] * budget) <= 51


def test_budget_and_entropy(spark):
    docs = sources(spark).where("source is not null")
    got = mixing.mixed(docs, entropy=1.5, budget=9_000).collect()
    w = {r.source: r._weight for r in got}
    assert math.isclose(-sum(x * math.log2(x) for x in w.values()), 1.5, abs_tol=1e-3)
    for s in w:
        assert abs(sum(r._tokens for r in got if r.source == s) - w[s] * 9_000) <= 51
    again = mixing.mixed(docs, entropy=1.5, budget=9_000).collect()
    assert sorted((r.doc_id, r._copy, r._offset) for r in got) == sorted((r.doc_id, r._copy, r._offset) for r in again)
    assert mixing.mixed(docs.where("false")).collect() == []


# pieces


@pytest.fixture(scope="module")
def model():
    with open(PIECES, "rb") as f:
        return pieces.Pieces(f.read())


def fuzz():
    random.seed(1)
    out = ["".join(random.choice("  \n\tabthe()=-*#éñ日本\x00'\"0123") for _ in range(random.randint(0, 60))) for _ in range(800)]
    out += [" " * n + "the" for n in range(40)]
    return out + ["".join(random.choice(["the", "ing", " ", "  ", "def ", "self.", "==", "\n    ", "/**", "Donau"]) for _ in range(40)) for _ in range(200)]


def test_ids_equal_the_library(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in fuzz():
        ids = model.encode(t)
        assert np.frombuffer(ids, "<i4").tolist() == sp.encode(t), t
        assert model.decode(ids) == t if t else not ids


def test_chunks_give_the_same_path(model):
    for t in [x for x in fuzz() if x][::3]:
        s = pieces.signs(t)
        for size in (17, 40):
            h = model.longest - 1
            parts = [(s[max(0, i - h) : i], s[i : i + size], s[i + size : i + size + h]) for i in range(0, len(s), size)]
            ms = [model.transfer(*p, k == 0, k == len(parts) - 1) for k, p in enumerate(parts)]
            states = pieces.cuts(ms)
            assert b"".join(model.traced(*p, states[k], states[k + 1]) for k, p in enumerate(parts)) == model.encode(t)


def test_products_associate():
    random.seed(2)
    m = [{(f"{i}:a", f"{j}:a"): float(random.randint(-3, 0)) for i in range(4) for j in range(4) if random.random() < 0.6} for _ in range(3)]
    assert pieces.combine(pieces.combine(m[0], m[1]), m[2]) == pieces.combine(m[0], pieces.combine(m[1], m[2]))


def test_giant_texts_equal_short_ones(awkward, nothing):
    whole = {(r.doc_id, r.n_pieces, r.ids_sha256, tuple(r.ids)) for r in pieces.encoded(awkward, PIECES, chunk=1 << 30, ids=True).collect()}
    cut = pieces.encoded(awkward, PIECES, chunk=64, ids=True).collect()
    assert {(r.doc_id, r.n_pieces, r.ids_sha256, tuple(r.ids)) for r in cut} == whole and len(cut) == awkward.count()
    assert all(r.round_trip for r in cut)
    assert pieces.encoded(nothing, PIECES).collect() == []


# pages

PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="ad">buy</div><div class="cookie-notice">we use cookies</div><aside>side</aside><article><h1>Head &amp; line</h1><p>One <b>bold</b>word
 more<br>next<p>Two&nbsp;three <a href="x">link</a><form>f</form><section id="comments"><p>nice!</p></section></article><footer>foot</footer>"""


def test_main_text(spark):
    rows = [(i, f"http://h{i % 2}.com/{i}", PAGE) for i in range(4)] + [(4, None, None), (5, "x", ""), (6, "y", "plain  text &lt;"), (6, "y", "plain  text &lt;"), (7, "http://h1.com/7", "<body><p>no container<div class=menu>m</div></body>")]
    got = [(r.page_id, r.text, r.n_chars) for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    main = "Head & line One boldword more next Two three link"
    want = [(i, main, len(main)) for i in range(4)] + [(4, "", 0), (5, "", 0), (6, "plain text <", 12), (6, "plain text <", 12), (7, "no container", 12)]
    assert sorted(got) == sorted(want)
    assert html.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_the_host_outvotes_a_page(spark):
    usual = "<body><div class='story'><p>{}</p></div><div class='extra7'><p>{}</p></div></body>"
    rows = [(i, "http://a.com/", usual.format("long words of a story " * 9, "short")) for i in range(5)] + [(5, "http://a.com/", usual.format("tiny", "much longer other text " * 9))]
    got = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5] == "tiny"
