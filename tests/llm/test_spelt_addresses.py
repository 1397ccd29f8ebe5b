"""Addresses that have neither a digit nor @."""

import numpy as np
import pytest

from tastemill.llm import pii

FORMS = [(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", ".")]
PROSE = "the old garden was quiet and the people went home before the rain came over the hill and "


@pytest.fixture(scope="module")
def tagger():
    model = pii.Tagger()
    model.fit(*pii.training_windows([PROSE * 5, "we met at noon near the river. then we sat at home, all of us, at last. " * 5], pii.SAMPLE_WINDOWS), epochs=pii.EPOCHS)
    return model


def spans(text, model):
    return pii.both(text, pii.base_spans(text), pii.tag([text], model)[0])


def test_spelt_addresses_are_found(tagger):
    draw = np.random.default_rng(5)
    word = lambda n: "".join(chr(97 + k) for k in draw.integers(0, 26, n))
    found = []
    for k in range(120):
        at, dot = FORMS[k % 4]
        local = word(draw.integers(3, 9)) + (f".{word(draw.integers(3, 9))}" if k % 3 == 0 else "")
        value = f"{local}{at}{word(draw.integers(4, 9))}{dot}{draw.choice(['com', 'org', 'net'])}"
        before = (PROSE * 4)[: int(draw.integers(100, 300))].rsplit(" ", 1)[0] + " "
        text = before + value + " " + PROSE * 2
        found.append((len(before), 0, len(before) + len(value)) in spans(text, tagger))
        assert not any(c.isdigit() or c == "@" for c in text)
    assert sum(found) > 0.8 * len(found), f"{sum(found)} of {len(found)}"


def test_prose_with_at_is_no_address(tagger):
    for text in ("we looked at home. then we stayed at the inn, all day", "she was at work at noon. they put a dot at the end. fine"):
        assert spans(text * 3, tagger) == []


def test_marks_are_whole_words():
    texts = ["at x", "that bat", "éat at", "a[at]b DOT c"]
    x, begin = pii.codes("".join(texts)), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    mark = pii.has_mark(x, begin)
    marked = ["".join(c if mark[a + k] else "." for k, c in enumerate(t)) for t, a in zip(texts, begin)]
    assert marked == ["at..", "........", "....at", "..at...DOT.."]


def test_windows_left_out_change_no_spelt_address(tagger, monkeypatch):
    text = PROSE * 3 + "jane.miller (at) somewhere (dot) com " + PROSE * 3 + "tom at host dot org " + PROSE
    some = spans(text, tagger)
    monkeypatch.setattr(pii, "has_mark", lambda x, begin: np.ones(len(x), bool))
    assert spans(text, tagger) == some
