"""Words that aren't known yet are scanned together; the ids are those of the scan of each one alone."""

from __future__ import annotations

import random

import numpy as np
import pytest

from brinewatch.llm import pieces as P
from brinewatch.llm.queries import PIECES


def model() -> P.Pieces:
    with open(PIECES, "rb") as f:
        return P.Pieces(f.read())


def awkward() -> list[str]:
    draw, p = random.Random(6), model()
    names = [t for t in p.id if len(t) > 1]
    words = ["".join(draw.choice(names).replace(P.BLANK, "") for _ in range(draw.randint(1, 5))) for _ in range(3_000)]
    words += ["".join(draw.choice("aeinrst.,éß!") for _ in range(draw.randint(1, 47))) for _ in range(3_000)]
    return [*words, "", " ", "   ", "  a", "a  ", "\n", "▁", "a▁b", "\U0001f600x\U0001f601", "ก�", "aaaaaaaaaaaaaaaa", "a" * 48, "a" * 49, "a" * 500, "日本語", "\x00"]


def by_one(p: P.Pieces, text: str) -> bytes:
    return b"".join(p.ids(p.trace(p.scan(w, 0, P.START), 0, len(w))) for w in p.word.findall(P.signs(text))) if text else b""


def test_together_is_each_alone(monkeypatch):
    texts = awkward()
    texts += [" ".join(texts[i : i + 20]) for i in range(0, 400, 20)] + [None]
    p = model()
    want = [by_one(p, t) if t else b"" for t in texts]
    p = model()
    assert p.encode_all(texts) == want
    monkeypatch.setattr(P, "WAVE", 7)
    monkeypatch.setattr(P, "KEPT_PAIRS", 50)  # pairs are forgotten within a scan
    assert model().encode_all(texts[:300]) == want[:300]


def test_together_equals_the_library():
    import sentencepiece

    sp, texts = sentencepiece.SentencePieceProcessor(model_file=PIECES), awkward()[::4]
    assert [np.frombuffer(i, "<i4").tolist() for i in model().encode_all(texts)] == [sp.encode(t) for t in texts]


def test_no_word_of_usual_length_is_scanned_alone(monkeypatch):
    texts = [f"the word{i} ofn{i}dhees, Straße!! {i}" for i in range(200)]
    p = model()
    want = [by_one(p, t) for t in texts]
    p = model()
    monkeypatch.setattr(p, "scanned", None)
    monkeypatch.setattr(p, "scan", None)
    assert p.encode_all(texts) == want


def test_chunks_words_are_scanned_together(monkeypatch):
    p, s = model(), P.signs("wordthatgoeson " * 40 + "and ends here")
    halo = p.longest - 1
    cuts = [(i, min(len(s), i + 50)) for i in range(0, len(s), 50)]
    rows = [{"left": s[max(0, i - halo) : i], "core": s[i:j], "right": s[j : j + halo]} for i, j in cuts]
    states = P.cuts([p.transfer(r["left"], r["core"], r["right"], k == 0, k == len(rows) - 1) for k, r in enumerate(rows)])
    rows = [r | {"entry": a, "exit": b} for r, a, b in zip(rows, states[:-1], states[1:], strict=True)]
    whole, p = p.encode(s[1:].replace(P.BLANK, " ")), model()
    monkeypatch.setattr(P.Known, "__missing__", None)  # each chunk's words are known before they are asked for
    assert b"".join(p.traced_all(rows)) == whole


def test_no_path_is_an_error(monkeypatch):
    p = model()
    monkeypatch.setattr(p, "fits", lambda a, b: False)
    with pytest.raises(ValueError, match="no path"):
        p.encode_all(["a word"])


def test_table():
    draw = np.random.default_rng(5)
    keys = np.unique(draw.integers(0, 1 << 40, 1_000))
    t = P.Table(1_500)
    assert (t.get(keys) == -1).all() and not len(t.get(keys[:0]))
    t.put(keys, np.arange(len(keys)))
    assert (t.get(keys) == np.arange(len(keys))).all() and (t.get(keys + (1 << 41)) == -1).all()
    more = keys + (1 << 41)
    t.put(more, np.arange(len(more)))  # beyond 1,500: what was held is forgotten
    assert (t.get(more) == np.arange(len(more))).all() and (t.get(keys) == -1).all()
