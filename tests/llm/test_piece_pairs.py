"""Two pieces may be neighbours exactly if BPE by definition gives them for their joined text; a pair costs no join of the whole text."""

from __future__ import annotations

import random

from brinewatch.llm import pieces as P
from brinewatch.llm.queries import PIECES


def test_apart_is_bpe_by_definition(monkeypatch):
    with open(PIECES, "rb") as f:
        p = P.Pieces(f.read())
    draw, names = random.Random(4), list(p.id)
    short = [t for t in names if len(t) < 4]
    pairs = [(draw.choice(short if draw.random() < 0.8 else names), draw.choice([*short, "\u4e00", "\U0001f600"] if draw.random() < 0.8 else names)) for _ in range(20_000)]
    # halves of pieces: what would be joined
    pairs += [(t[:k], t[k:]) for t in draw.sample(names, 3_000) for k in range(1, len(t))]
    pairs = [(a, b) for a, b in pairs if all(t in p.id or len(t) == 1 for t in (a, b))]
    want = [p.merged(a + b) == [a, b] for a, b in pairs]
    assert [p.apart(a, b) for a, b in pairs] == want and {*want} == {True, False}
    monkeypatch.setattr(p, "joins", None)
    assert [p.follows(a, b) for a, b in pairs] == want  # both pieces' own joins are known, so nothing is joined again


def test_ties_join_leftmost():
    p = object.__new__(P.Pieces)
    p.score, p.edges = {"aa": -1.0, "ab": -1.0, "ba": -1.0, "aab": -2.0, "bb": -0.5, "abb": -3.0}, {0: {}, -1: {}}
    pieces = ["a", "b", *p.score]
    for a in pieces:
        for b in pieces:
            assert p.apart(a, b) == (p.merged(a + b) == [a, b]), (a, b)
