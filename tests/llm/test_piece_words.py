"""The piece encoder's kept words are bounded, also within one call, and forgetting words changes no ids."""

from __future__ import annotations

from brinewatch.llm import pieces as P
from brinewatch.llm.queries import PIECES


def test_kept_words_are_bounded_and_ids_stay(monkeypatch):
    with open(PIECES, "rb") as f:
        model = f.read()
    texts = [" ".join(f"the word{i * 40 + k} of{k}" for k in range(40)) for i in range(30)] + [None, ""]
    whole = P.Pieces(model)
    want = [whole.encode(t) for t in texts]
    monkeypatch.setattr(P, "KEPT_WORDS", 50)
    p = P.Pieces(model)
    for _ in range(2):
        assert p.encode_all(texts) == want
        assert len(p.known) + len(getattr(p.known, "old", ())) <= 2 * P.KEPT_WORDS
    assert [p.encode(t) for t in texts] == want and len(p.known) + len(p.known.old) <= 2 * P.KEPT_WORDS
