"""The registered queries over whole tables: against their SQL, or against plain computations of what their contract fixes."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import time
import zlib

import duckdb
import pytest

from brinewatch.llm import html, pii, queries

from test_pii import slow_plain

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(db):
    return {i: t or "" for i, t in db.execute("SELECT doc_id, text FROM documents").fetchall()}


def result(spark, name):
    return queries.queries()[name](spark, SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_duckdb(spark, db, name):
    got = result(spark, name)
    want = db.execute(queries.oracle_sql()[name])
    names = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == names
    at = [[c[0] for c in want.description].index(n) for n in names]
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def op6_of(spark, folder, rows, labels):
    """The verdicts of op6 over made pages (id, url) and labels, and those of its SQL."""
    spark.createDataFrame([(i, u, "") for i, u in rows], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, verdict FROM ({queries.oracle_sql()['op6_url_rules']})").fetchall()
    return sorted((r.page_id, r.verdict) for r in queries.op6_url_rules(spark, str(folder)).collect()), sorted(want)


def test_op6_mined_rules_match_duckdb(spark, tmp_path):
    rows = [(i, f"http://{h}.example.fr/{p}/{i}.html") for i, (h, p) in enumerate((h, p) for _ in range(60) for h in ("spam", "good", "fine") for p in ("win", "news"))]
    got, want = op6_of(spark, tmp_path, rows, [(i, int(not ("spam" in u and "win" in u)), 0) for i, u in rows] + [(None, 0, 1), (5, None, None)])
    assert got == want and collections.Counter(v for _, v in got)["block"] == 60


@pytest.mark.parametrize("bad", ["all", "half"])
@pytest.mark.parametrize("apart", [False, True])
def test_op6_many_shared_tokens(spark, tmp_path, bad, apart):
    """Forty parts that all labelled URLs share, or of which each lacks another one; unlabelled pages with one of them."""
    parts = [f"part{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    rows = [(i, "http://h.fr/" + "/".join(p for k, p in enumerate(parts) if not apart or k != i % 40) + f"/{i}") for i in range(60)]
    rows += [(1000 + k, f"http://{'x' if k % 2 else 'h'}.fr/{p}/x") for k, p in enumerate(parts)]
    began = time.monotonic()
    got, want = op6_of(spark, tmp_path, rows, [(i, int(bad == "half" and i % 3 > 0), 0) for i in range(60)])
    assert got == want and {v for _, v in got} == ({"block"} if bad == "all" else {"allow"}) and time.monotonic() - began < 120


def test_op1_base_and_spans(spark, texts):
    for r in result(spark, "op1_pii_spans").collect():
        base = slow_plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert {x for x in text.split(",") if x} <= set(r.spans.split(","))


def test_op2_counts_and_base(spark, texts):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    tokens = {i: [*WORDS.findall(t.translate(LOWER)), None] for i, t in texts.items()}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    gain = 0.0
    for r in result(spark, "op2_lm_score").collect():
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0  # the model is better than the base on texts that it has not seen


def test_op5_payloads(spark, texts):
    for r in result(spark, "op5_media_features").collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op8_base(spark, texts):
    for r in result(spark, "op8_quality_rules").collect():
        t = texts[r.doc_id]
        w = WORDS.findall(t)
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = collections.Counter(windows)
        repeated = len({j for i, x in enumerate(windows) if twice[x] > 1 for j in range(i, i + 5)})
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * repeated > 20 * len(w)) and r.kept == (not r.base_failed and r.rule is None)


def test_op10_articles(spark, db):
    pages = {i: h for i, h in db.execute("SELECT page_id, html FROM pages").fetchall()}
    rows = result(spark, "op10_main_text").collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id] or "")
        if article:
            blocks = re.sub(r"</?(?:p|h[1-6]|li|ul|div|br)\b[^>]*>", " ", article[1])
            assert r.text == " ".join(html.references.unescape(re.sub(r"<[^>]+>", "", blocks)).split()) and r.n_chars == len(r.text)
