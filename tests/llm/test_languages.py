"""Language filters against plain Python sets of n-grams, and former limits."""

import collections
import random

import numpy as np
import pytest

from tastemill.llm import langid
from tests.llm.test_contracts import FOLDER, ODD


def plain_grams(text, size=langid.GRAM):
    kept, after = [], False
    for b in (text or "").encode():
        letter = bytes([b]).isalpha() or b >= 0x80
        if letter or after:
            kept.append(bytes([b]).lower() if letter and b < 0x80 else bytes([b]) if letter else b" ")
        after = letter
    spaced = b"  " + b"".join(kept) + b" " * (size - 2)
    found = [spaced[k : k + size] for k in range(len(spaced) - size + 1)]
    return [g for g in found if g.strip(b" ")]


def plain_languages(rows):
    """The n-grams that tell of each language."""
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        if text is not None and lang is not None:
            counts[lang].update(plain_grams(text))
    counts = {k: c for k, c in counts.items() if c}
    total = {k: sum(c.values()) for k, c in counts.items()}
    rate = {k: {g: n / total[k] for g, n in c.items() if n >= langid.least_count(total[k])} for k, c in counts.items()}
    most = collections.Counter()
    for r in rate.values():
        for g, x in r.items():
            most[g] = max(most[g], x)
    return {k: {g for g, x in r.items() if x >= langid.LEAST_SHARE * most[g]} for k, r in rate.items()}


def codes(rows):
    texts = [(t or "").encode() for t in rows]
    data = np.frombuffer(b"".join(texts), np.uint8)
    return langid.grams(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))


def test_grams():
    """Also where a row ends in a letter and the next begins with none."""
    rows = ["Abc", " def", "", "1 x", None, "straße 7 ok", "...", "a"]
    code, row = codes(rows)
    got = [[int(c).to_bytes(langid.GRAM, "big") for c in code[row == k]] for k in range(len(rows))]
    assert got == [plain_grams(t) for t in rows]


def test_equals_sets(spark):
    """Scores are those of exact sets but for what the filter's correction leaves open."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(10_000 + k, t, None) for k, (_, t) in enumerate(ODD)], docs.schema))
    rows = docs.collect()
    learned = plain_languages([(r["text"], r["lang"]) for r in rows])
    model = langid.learn(docs)
    assert model.languages == sorted(learned) and model.wrong.max() < 0.01
    said = {(r["doc_id"], r["text"]): r for r in langid.predict(docs, model).collect()}
    judged = 0
    for r in rows:
        found, got = plain_grams(r["text"]), said[r["doc_id"], r["text"]]
        assert got["n_grams"] == len(found)
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (got["lang_pred"], got["score"]) == (langid.UNKNOWN, 0.0)
            continue
        share = sorted(((sum(g in s for g in found) / len(found), k) for k, s in learned.items()), reverse=True)
        assert abs(got["score"] - share[0][0]) < 0.02
        if share[0][0] > share[1][0] + 0.05:
            assert got["lang_pred"] == share[0][1]
            judged += 1
    assert judged > 150


def made(seed, words=40):
    draw = random.Random(seed)
    letters = draw.sample("abcdefghijklmnopqrstuvwxyz", 9)
    return ["".join(draw.choice(letters) for _ in range(6)) for _ in range(words)]


def test_many_languages(spark, monkeypatch):
    """All of 130 languages of little text are learned; beyond the limit there is an error, not a loss."""
    rows = [(f"l{k:03d}", " ".join(made(k))) for k in range(130)]
    train = spark.createDataFrame(rows, "lang string, text string")
    model = langid.learn(train)
    assert len(model.languages) == 130 and model.masks.shape[1] == 3
    asked = spark.createDataFrame([(lang, " ".join(made(k)[5:25])) for k, (lang, _) in enumerate(rows)], "lang string, text string")
    assert langid.predict(asked, model).where("lang_pred != lang").count() == 0
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 129)
    with pytest.raises(ValueError):
        langid.learn(train)


def test_slots_follow_the_largest_language(spark):
    draw = random.Random(4)
    text = " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(3000))
    train = spark.createDataFrame([("big", text), ("small", "one two three")], "lang string, text string")
    model = langid.learn(train, slot_count=1 << 10)
    used = len(plain_languages([(text, "big"), ("one two three", "small")])["big"])
    assert len(model.masks) >= langid.ROOM * used and model.wrong.max() < 0.07


def test_least_count():
    """At most 1 / LEAST_RATE n-grams of a language count; small languages need fewer uses."""
    assert [langid.least_count(t) for t in (10, 100_000, 7_000_000, 10**10)] == [1.0, 3, 3, 4000.0]
    assert all(t / langid.least_count(t) <= 1 / langid.LEAST_RATE * 1.0001 for t in (10, 10**6, 10**8, 10**12))
