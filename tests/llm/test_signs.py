"""Written-out signs alone in a text, which the precheck must not pass over."""

from __future__ import annotations

import pytest

from brinewatch.llm import pii


@pytest.mark.parametrize("text", ("192<.>168<.>0<.>1", "10( . )0( . )0( . )1", "see joe( at )example.com", "joe(\tat)example.com", "joe_at-example.com"))
def test_signs_are_found_without_others_in_the_text(text):
    hidden = pii.find_spans(text)[1]
    assert hidden and hidden == pii.find_spans(f"{text} , dot")[1]
    assert "<EMAIL>" in pii.redact(text) or "<IP>" in pii.redact(text)
