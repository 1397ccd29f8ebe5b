"""The word restaurants of operator 7: totals, mass, order of words, and a plain sampler."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.llm import pitman_yor as py
from tastemill.llm.common import run_hashes, share
from tastemill.session import stage

TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "", None, "The cat sat", "on the mat the cat sat " * 30]
TEXTS += [f"number {k % 7} of {k % 3} things the {k} cat" for k in range(60)]


@pytest.fixture(scope="module")
def learnt(spark):
    docs = spark.createDataFrame([(k, t, True) for k, t in enumerate(TEXTS)], "doc_id long, text string, train boolean").repartition(3)
    contexts = py.frequent(stage(py.vocabulary(docs, 5), "words"))
    vocab = stage(py.vocabulary(docs, 5, share(spark, contexts)), "pairs")
    rows = [tuple(bytes(r[c]) for c in ("words", "sizes", "contexts", "counts")) for r in vocab.collect()]
    return contexts, py.Lexicon(rows), py.learn(vocab, 6, 3)


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(run_hashes(data, np.array([0]), np.array([len(data)]))[0])


def test_pairs_are_counted(learnt):
    contexts, words, _ = learnt
    name = {word_hash(w): w for t in TEXTS for w in [*(t or "").lower().split(), ""]}
    of = lambda w: int(contexts.of(np.array([word_hash(w)], np.uint64))[0])
    want = Counter()
    for t in TEXTS:
        before = 0
        for w in [*(t or "").lower().split(), ""]:
            want[before, w] += 1
            before = of(w)
    got = {(int(k), name[int(words.hashes[w])]): int(n) for k, w, n in zip(words.context, words.word, words.counts)}
    assert got == want


def test_probabilities_add_up(learnt):
    """After each context, and for single words, those known and the spelled rest make one."""
    _, words, model = learnt
    single, pair = model.discounts
    for s in model.kept:
        seated, customers, tables = model.seats(words, words.log_spelled(s.spelling), s.before, s.sweep)
        seated = words.all_tables(seated)
        assert np.array_equal(np.bincount(words.context, seated, py.CONTEXTS), s.after.context_tables)
        assert (customers.sum(), tables.sum()) == (s.after.customers, s.after.tables)
        assert (seated <= words.counts).all() and (tables <= customers).all() and (tables >= 1).all()
        all_ = s.after.customers + py.STRENGTH
        assert abs(((customers - single * tables) / all_).sum() + (py.STRENGTH + single * s.after.tables) / all_ - 1) < 1e-9
    own, _ = model.predict(words)
    mass = np.bincount(words.context, own, py.CONTEXTS) + np.exp(model.log_back()).mean(axis=0)
    assert np.abs(mass - 1).max() < 1e-9


def test_order_of_words_counts(spark):
    rows = [(k, "red fish blue bird green tree") for k in range(40)]
    rows += [(100, "red fish blue bird"), (101, "fish red bird blue"), (102, "red fish zebra bird")]
    found = {r["doc_id"]: r for r in py.verdicts(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 100").collect()}
    assert found[100]["base_score"] == pytest.approx(found[101]["base_score"])
    assert found[100]["score"] > found[101]["score"] + 1 and found[100]["score"] > found[102]["score"]


def test_start_and_shared_contexts(learnt, monkeypatch):
    contexts = learnt[0]
    rare = np.array([word_hash("neverseen"), word_hash("norwasthis")], np.uint64)
    assert (contexts.of(rare) > py.OWN).all() and (contexts.of(rare) < py.CONTEXTS).all()
    own = contexts.of(contexts.hashes)
    assert len(set(own.tolist())) == len(own) and own.min() == 1


def test_frequent_words_stay_within_the_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(" ".join(f"w{k}" for k in range(n)), True) for n in range(1, 40)], "text string, train boolean")
    vocab = stage(py.vocabulary(docs, 3), "words")
    monkeypatch.setattr(py, "OWN", 10)
    found = set(py.frequent(vocab).hashes.tolist())
    assert 5 <= len(found) <= 10 and found <= {word_hash(w) for w in ["", *(f"w{k}" for k in range(12))]}


def test_seats_agree_with_a_plain_sampler():
    """Mean tables against customers taken out and seated again one at a time."""
    draw = random.Random(4)
    pairs = {(k, w): draw.choice([1, 1, 2, 3, 6, 15]) for k in range(6) for w in range(8) if draw.random() < 0.7}
    names = sorted({w for _, w in pairs})
    text = "".join(f"{'abcdefgh'[w]} " for w in names).encode()
    sizes = [sum(v == w for _, v in pairs) for w in names]
    contexts = [k for w in names for k in sorted(c for c, v in pairs if v == w)]
    counts = [pairs[k, w] for w in names for k in sorted(c for c, v in pairs if v == w)]
    packed = py._packed(np.array(sizes), np.array(contexts))
    lexicon = py.Lexicon([(text, *packed, py._packed_counts(np.array(counts)))])
    single, pair, base = 0.5, 0.6, 1 / 20
    customers = np.bincount(contexts, counts, py.CONTEXTS)
    model = py.Model(sum(counts), len(names), (single, pair), customers)
    spelled = np.full(len(names), np.log(base))
    given = py.Totals(np.bincount(contexts, minlength=py.CONTEXTS), len(contexts), len(names))
    trace = []
    for sweep in range(400):
        seated, guests, tables = model.seats(lexicon, spelled, given, sweep)
        seated = lexicon.all_tables(seated)
        given = py.Totals(np.bincount(lexicon.context, seated, py.CONTEXTS), int(guests.sum()), int(tables.sum()))
        trace.append((given.customers, given.tables))
    got = np.mean(trace[50:], axis=0)

    low = {p: [1] * n for p, n in pairs.items()}
    high = {w: [1] * sum(len(low[p]) for p in low if p[1] == w) for w in names}

    def enter(tables, discount, opening):
        at = draw.random() * (sum(t - discount for t in tables) + opening)
        for k, t in enumerate(tables):
            at -= t - discount
            if at < 0:
                tables[k] += 1
                return False
        tables.append(1)
        return True

    def leave(tables):
        k = draw.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    want = []
    for sweep in range(400):
        for (k, w), n in pairs.items():
            for _ in range(n):
                if leave(low[k, w]):
                    leave(high[w])
                all_ = sum(map(sum, high.values())) + py.STRENGTH
                opening = py.STRENGTH + single * sum(map(len, high.values()))
                parent = (sum(high[w]) - single * len(high[w]) + opening * base) / all_
                if enter(low[k, w], pair, (py.STRENGTH + pair * sum(len(t) for p, t in low.items() if p[0] == k)) * parent):
                    enter(high[w], single, opening * base)
        want.append((sum(map(len, low.values())), sum(map(len, high.values()))))
    assert got == pytest.approx(np.mean(want[50:], axis=0), rel=0.1), (got, np.mean(want[50:], axis=0))


def test_counts_are_packed():
    for counts in ([], [1, 2, 254], [255, 1, 10**12, 256, 3]):
        counts = np.array(counts, np.int64)
        assert np.array_equal(py._unpacked_counts(py._packed_counts(counts), len(counts)), counts)


def test_very_long_words_have_a_score(spark):
    rows = [(k, "plain words in rows") for k in range(20)] + [(105, "plain " + "qz" * 20_000)]  # held out
    found = {r["doc_id"]: r["score"] for r in py.verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.isfinite(found[105]) and found[105] < -10_000
