from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from brinewatch.llm import pii


def slow_plain(text):
    """The contract's patterns, written again."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if (len(d) - i) % 2 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_plain_spans_match_the_patterns():
    random.seed(2)
    bits = ["a@b.c", "1.2.3.4", "999.1.1.1", "4785380592391139", "4785 3805-9239 1139", "+1 (663) 555-6869", "+", "@", ".", " ", "-", "x", "12", "é", "\n", "0"]
    for _ in range(3000):
        t = "".join(random.choice(bits) for _ in range(random.randint(0, 12)))
        got = [(k, s, e) for k in pii.KINDS for s, e in pii.plain_spans(t)[k]]
        assert got == slow_plain(t), t


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john.doe (at) mail5 dot example dot com now", "email", "john.doe (at) mail5 dot example dot com"),
        ("x john [at] example.com", "email", "john [at] example.com"),
        ("x user@mail5․example․com", "email", "user@mail5․example․com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("jane at corp dot example dot org", "email", "jane at corp dot example dot org"),
        ("ip 192[.]168[.]0[.]1 ok", "ip", "192[.]168[.]0[.]1"),
        ("ip one nine two dot one six eight dot zero dot one end", "ip", "one nine two dot one six eight dot zero dot one"),
        ("card ４７８５３８０５９２３９１１３９", "card", "４７８５３８０５９２３９１１３９"),
        ("4785​3805​9239​1139", "card", "4785​3805​9239​1139"),
        ("four seven eight five three eight zero five nine two three nine one one three nine", "card", "four seven eight five three eight zero five nine two three nine one one three nine"),
        ("call +1 (743) five five five-3824", "phone", "+1 (743) five five five-3824"),
    ],
)
def test_disguises_map_back_to_source(text, kind, span):
    plain, hidden = pii.find_spans(text)
    assert [text[s:e] for s, e in hidden[kind]] == [span]
    assert not plain[kind]
    assert span not in pii.redact(text)


@pytest.mark.parametrize("text", ["we met at noon. one two three go dot com", "look at example.com now", "at the dot", "one, two, three, four", "Élan ² ½ ligne", "twenty one people at the door"])
def test_clean_texts_have_none(text):
    plain, hidden = pii.find_spans(text)
    assert not any(plain.values()) and not any(hidden.values())
    assert pii.redact(text) == text


def test_rewriting_keeps_offsets():
    r = pii.Rewritten("abXYcdZef")
    r.replace([(2, 4, "1"), (6, 7, "234")])
    assert r.text == "ab1cd234ef"
    r.replace([(0, 1, ""), (3, 5, "__")])
    assert r.text == "b1__234ef"[0:2] + r.text[2:]
    s = r.text.index("234")
    assert r.source(s, s + 3)[:2] == (6, 7)
    assert r.source(r.text.index("ef"), len(r.text)) == (7, 9, False)


def test_query_columns(awkward, nothing):
    got = {r.doc_id: r for r in pii.personal_data(awkward).collect()}
    assert (got[12].n_email, got[12].n_ip, got[12].n_card, got[12].n_phone, got[12].n_hidden) == (1, 1, 0, 1, 1)
    text = next(r.text for r in awkward.collect() if r.doc_id == 12)
    base = ",".join(f"{k}:{s}:{e}" for k, s, e in slow_plain(text))
    assert got[12].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert set(base.split(",")) < set(got[12].spans.split(","))
    assert got[4].spans == "" and got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(awkward).count() == awkward.count()
    assert pii.personal_data(nothing).collect() == []


def test_redacted_keeps_columns(awkward):
    out = pii.redacted(awkward)
    assert out.columns == awkward.columns
    by = {r.doc_id: r for r in out.collect()}
    assert by[4].text is None and by[5].text == ""
    assert by[12].text == "mail <EMAIL> or <EMAIL>, <PHONE>, <IP>"


@pytest.mark.parametrize("piece", ["a", "1", "1.", "a@", "@", "a_dot_", "_at_", " at ", "( ", "one ", "1 ", "a@b.c ", "+1(", "о"])
def test_time_is_proportional_to_the_text(piece):
    def seconds(n):
        began = time.process_time()
        pii.find_spans(piece * n + " x@y.z 1.2 dot")
        return time.process_time() - began

    small, large = seconds(40_000), seconds(160_000)
    assert large < 8 * small + 0.2  # 16 times where it is quadratic


def test_five_megabytes_of_one_word():
    text = "a" * 5_000_000 + "@example.com"
    assert pii.plain_spans(text)["email"] == [(0, len(text))]


@pytest.mark.parametrize(("text", "plain"), [("jоhn@example.com", (2, 16)), ("jo​hn@example.com", (3, 17)), ("jane (dot) doe@corp.org", (11, 23))])
def test_a_disguise_that_widens_a_plain_span_is_added(text, plain):
    base, hidden = pii.find_spans(text)
    assert base["email"] == [plain] and hidden["email"] == [(0, len(text))]
    assert pii.redact(f"x {text} y") == "x <EMAIL> y"


def test_a_bare_at_needs_a_known_last_label():
    assert not pii.find_spans("meet at noon dot the")[1] and not pii.find_spans("we sat at home dot so there")[1]


def test_awkward_rows_and_clashing_columns(spark, awkward, nothing):
    docs = awkward.withColumn("spans", pii.F.lit("mine")).withColumn("n_email", pii.F.lit(5))
    rows = docs.collect()
    got = pii.personal_data(docs).collect()
    assert sorted((r.doc_id or -1, r.spans) for r in got) == sorted((r.doc_id or -1, pii.joined({k: p[k] + h.get(k, []) for k in pii.KINDS})) for r in rows for p, h in [pii.find_spans(r.text or "")])
    assert pii.redacted(docs).columns == docs.columns and pii.redacted(docs).count() == len(rows)
    assert pii.personal_data(nothing).collect() == [] and pii.redacted(nothing).collect() == []
