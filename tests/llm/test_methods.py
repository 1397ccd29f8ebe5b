"""The parts of the methods: transform, trees, seating, training, quotas."""

import math
import tracemalloc

import numpy as np
import pytest

from tastemill.llm import decontaminate, filters, jaccard, pii, pitman_yor, repeats, sharding
from tastemill.llm.links import components


def random_pieces(draw, count, letters=3, most=40):
    sizes = draw.integers(1, most, count)
    return [bytes(draw.integers(97, 97 + letters, n).astype(np.uint8)) for n in sizes]


@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_collection_is_the_sorted_suffixes(tmp_path, monkeypatch, chunk):
    """Symbols and common prefixes equal those of all suffixes sorted, for files read in any chunks."""
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    draw = np.random.default_rng(chunk)
    for trial in range(8):
        own = random_pieces(draw, int(draw.integers(1, 12)))
        folder = tmp_path / str(trial)
        folder.mkdir()
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in own])])
        files = repeats.collection(np.frombuffer(b"".join(own), np.uint8), offsets, str(folder))
        got = [np.concatenate(x) for x in zip(*((s, c) for _, s, c in files.read()))]
        suffixes = sorted((p[a:], k, a) for k, p in enumerate(own) for a in range(len(p) + 1))
        # a suffix that ends stands before longer ones; equal ones by piece
        want = [own[k][a - 1] if a else repeats.END for _, k, a in suffixes]
        assert got[0].tolist() == want
        common = [0] + [next((i for i, (x, y) in enumerate(zip(s, t)) if x != y), min(len(s), len(t))) for (s, *_), (t, *_) in zip(suffixes, suffixes[1:])]
        assert got[1].tolist() == common


def test_least_documents():
    own = [b"abcdefgh", b"bcdefgh", b"xxabcdxx", b"abcd"]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in own])])
    best, ends = repeats.least_documents(np.frombuffer(b"".join(own), np.uint8), offsets, np.array([5, 3, 9, 7]), 4)
    found = {(k, a): int(best[ends[k] + a]) for k, p in enumerate(own) for a in range(len(p) - 3)}
    least = {}
    for k, p in enumerate(own):
        for a in range(len(p) - 3):
            least[p[a : a + 4]] = min(least.get(p[a : a + 4], 99), [5, 3, 9, 7][k])
    assert found == {(k, a): least[p[a : a + 4]] for k, p in enumerate(own) for a in range(len(p) - 3)}


def test_pieces_hold_every_window_once():
    draw = np.random.default_rng(3)
    texts = [bytes(draw.integers(97, 101, int(n)).astype(np.uint8)) for n in (0, 49, 50, 51, 400, 3, 1000, 50)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, first, end, hashes = repeats.pieces(np.frombuffer(b"".join(texts), np.uint8), offsets)
    seen = [(int(r), w) for r, a, b in zip(row, first, end) for w in range(a, b - 49)]
    assert sorted(seen) == [(r, offsets[r] + w) for r, t in enumerate(texts) for w in range(len(t) - 49)]
    by_window = {}
    data = b"".join(texts)
    for a, b, h in zip(first, end, hashes):
        assert b - a <= 80
        for w in range(a, b - 49):
            assert by_window.setdefault(data[w : w + 50], h) == h


def test_pieces_of_a_text_longer_than_a_segment(monkeypatch):
    draw = np.random.default_rng(5)
    data = draw.integers(97, 101, 5000).astype(np.uint8)
    offsets = np.array([0, 5000])
    whole = repeats.pieces(data, offsets)
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    assert all(np.array_equal(a, b) for a, b in zip(whole, repeats.pieces(data, offsets)))


def test_filter_has_no_false_negative(spark):
    keys = [int(k) * 7919 - 500 for k in range(3000)]
    words = filters.build(spark.createDataFrame([(k,) for k in keys] + [(None,)], "key long"), "key", 3000)
    assert filters.contains(words, np.array(keys)).all()
    assert filters.contains(words, np.arange(10**9, 10**9 + 20_000)).mean() < 0.05


def test_components(spark):
    draw = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 300, (180, 2))] + [(k, k + 1) for k in range(400, 460)] + [(7, 7), (None, 3), (500, None)]
    edges += [(1000, k) for k in range(1001, 1400)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {}
    for x in parent:
        least[top(x)] = min(least.get(top(x), x), x)
    assert found == {x: least[top(x)] for x in parent}


def test_tree_finds_all_that_can_link():
    draw = np.random.default_rng(2)
    counts = draw.poisson(3, (600, jaccard.GROUPS)).astype(np.int32)
    counts[300:] = np.maximum(counts[:300] + draw.integers(-1, 2, (300, jaccard.GROUPS)) * (draw.random((300, jaccard.GROUPS)) < 0.1), 0)
    sizes = counts.sum(axis=1)
    tree, live = jaccard.RTree(counts, sizes), np.ones(600, bool)
    live[::7] = False
    for k in range(0, 600, 11):
        bound = np.minimum(counts, counts[k]).sum(axis=1)
        want = np.flatnonzero(live & jaccard.reaches(bound, sizes + sizes[k]))
        assert set(tree.near(counts[k], sizes[k], live).tolist()) == set(want.tolist())


def test_spanning_links_do_not_grow_with_pairs():
    counts = np.full((500, jaccard.GROUPS), 5, np.int32)
    left, right = jaccard.spanning(counts, counts.sum(axis=1))
    assert len(left) == 499 and set(right.tolist()) | {int(left[0])} == set(range(500))


def test_first_shingles_meet():
    draw = np.random.default_rng(4)
    frequent = np.sort(draw.integers(0, 1 << 60, 50).astype(np.uint64))
    for _ in range(200):
        n = int(draw.integers(1, 80))
        a = np.unique(np.concatenate([draw.integers(0, 1 << 60, n).astype(np.uint64), frequent[:20]]))
        b = np.unique(np.concatenate([a[draw.random(len(a)) > 0.06], draw.integers(0, 1 << 60, int(n * 0.03)).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        value, ends = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        first, cut = jaccard.firsts(value, ends, frequent)
        if 100 * same >= 90 * (len(a) + len(b) - same):
            assert len(np.intersect1d(first[: cut[1]], first[cut[1] :]))


def test_sets_that_can_link_meet_in_a_band():
    for size in range(1, 400):
        for other in range(size, size * 100 // 90 + 1):
            first, ends = np.array([7, 7], np.uint64), np.array([0, 1, 2])
            keys, cut = jaccard.meeting_keys(first, ends, np.array([size, other]))
            assert set(keys[: cut[1]].tolist()) & set(keys[cut[1] :].tolist())


def test_points_are_packed_without_loss():
    counts = np.zeros((4, jaccard.GROUPS), np.int32)
    counts[1, 3], counts[2, 5], counts[3, 7] = 255, 256, 1 << 20
    assert np.array_equal(jaccard.unpacked(jaccard.packed(counts)), counts)


def test_search_finds_short_and_long_patterns():
    items = [(1, "a"), (2, "b c"), (3, " ".join(f"w{k}" for k in range(30))), (4, "d e f g h i j")]
    text = "x a x b c x " + " ".join(f"w{k}" for k in range(3, 29)) + " d e f g h i j a"
    data = np.frombuffer(text.encode(), np.uint8)
    norm, places, first = decontaminate.normalise(data, np.array([0, len(data)]))
    found = set()
    for t in decontaminate.build(items):
        at, member = t.search(norm)
        found |= {(int(np.searchsorted(places, p)), t.patterns[m][0].decode()) for p, m in zip(at, member)}
    words = text.split()
    want = set()
    for _, item in items:
        w = item.split()
        for a in range(max(1, len(w) - 12)):
            own = w[a : a + 13]
            want |= {(k, f" {' '.join(own)} ") for k in range(len(words)) if words[k : k + len(own)] == own}
    assert found == want and len(want) > 14


def test_seating_follows_the_law():
    """Mean number of tables against the law summed in plain Python, below and above the exact route's bound."""
    keys = np.arange(4000, dtype=np.uint64) * np.uint64(977)
    for n, opens, parent, discount in ((40, 3.0, 0.9, 0.5), (100, 40.0, 0.01, 0.7), (700, 5.0, 0.2, 0.6), (3000, 200.0, 0.02, 0.8)):
        ways = [0.0]
        for c in range(1, n):
            join = [w + math.log(c - (t + 1) * discount) for t, w in enumerate(ways)] + [-math.inf]
            opened = [-math.inf, *ways]
            ways = [max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b) for a, b in zip(join, opened)][:400]
        law, weight = [], 0.0
        for t, w in enumerate(ways):
            law.append(w + weight)
            weight += math.log((opens + discount * (t + 1)) * parent)
        top = max(law)
        law = [math.exp(v - top) for v in law]
        want = sum((t + 1) * v for t, v in enumerate(law)) / sum(law)
        got = pitman_yor.seat(np.full(4000, n), np.full(4000, opens), np.full(4000, parent), discount, keys, 3).mean()
        assert abs(got - want) < (0.03 if n <= pitman_yor.EXACT else 0.06) * want, (n, got, want)
    none = np.zeros(2, np.uint64)
    assert pitman_yor.seat(np.array([0, 1]), np.ones(2), np.ones(2), 0.5, none, 0).tolist() == [0, 1]


def test_spelling_is_a_distribution():
    text = b"the then there theme and sand band hand "
    data = np.frombuffer(text, np.uint8)
    codes, counts = np.unique(pitman_yor.spell(data), return_counts=True)
    own = pitman_yor.Spelling().sample(codes, counts, 1)
    for context in (b"th", b"zz", b" a", b"nd"):
        cells = np.array([context[0] << 16 | context[1] << 8 | b for b in range(256)])
        assert abs(own.probability(cells).sum() - 1) < 1e-9
    good, bad = (own.log_words(np.frombuffer(w, np.uint8), np.array([0]))[0] for w in (b"than ", b"xqzw "))
    assert good > bad


def test_known_words_are_likelier(spark):
    rows = [(k, "alpha beta gamma alpha") for k in range(40)] + [(100, "alpha beta"), (101, "delta zeta")]
    found = {r["doc_id"]: r["score"] for r in pitman_yor.verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100] > found[101]


def test_tagger_gradients():
    draw = np.random.default_rng(8)
    model = pii.Tagger()
    x, y = draw.integers(0, pii.CLASSES, (3, 7)).astype(np.int16), np.zeros((3, 7), np.int8)
    y[0, 1:4], y[1, 0], y[2, 5:] = (1, 2, 2), 3, (7, 8)
    mask = np.ones((3, 7), bool)
    mask[1, 5:] = False
    y[1, 5:] = 0
    loss, grads = model.step(x, y, mask)
    for name in ("out", "hf", "hb", "xf", "move", "embed", "first", "cb"):
        flat = model.p[name].ravel()
        touched = np.flatnonzero(np.abs(grads[name].ravel()) > 1e-4)
        for k in touched[:: max(1, len(touched) // 4)][:4]:
            was, step = flat[k], np.float32(1e-2)
            flat[k] = was + step
            up = model.step(x, y, mask)[0]
            flat[k] = was - step
            down = model.step(x, y, mask)[0]
            flat[k] = was
            assert abs((up - down) / (2 * step) * 16 - grads[name].ravel()[k]) < 0.05 * max(0.1, abs(grads[name].ravel()[k]))
    assert loss > 0


@pytest.fixture(scope="module")
def tagger():
    texts = ["plain words stand here and there in a row of nothing special at all, " * 4, "numbers 12 and 1999 and 3.14 with words between, 7 of them or 8 " * 4]
    model = pii.Tagger()
    model.losses = model.fit(*pii.training_windows(texts, pii.SAMPLE_WINDOWS), epochs=pii.EPOCHS)
    return model


def test_tagger_learns(tagger):
    assert tagger.losses[-1] < 0.3 * tagger.losses[0]
    texts = ["plain words stand here and there in a row of nothing special at all, " * 3]
    x, y, mask = pii.training_windows(texts, 300, seed=99)
    found = tagger.decode(x, mask)
    marked = (y > 0) & mask
    assert (found[marked] > 0).mean() > 0.9 and (found[mask & ~marked] > 0).mean() < 0.02


def test_windows_meet(tagger):
    """A long text's spans are those of its parts; places count from the text's start."""
    part = "words before it and call 555-123-4567 or so then words after it again " * 2
    texts = [part * 4, "", part]
    found = pii.tag(texts, tagger)
    assert found[1] == [] and found[2]
    kinds = {texts[0][a:b] for a, k, b in found[0] if k == 3}
    assert "555-123-4567" in kinds
    assert sum(texts[0][a:b] == "555-123-4567" for a, k, b in found[0]) >= 6


def test_masking():
    text = "a x@y.zz b +1 555 123 4567 c"
    spans = pii.base_spans(text)
    assert pii.mask_text(text, spans) == "a <email> b <phone> c"
    assert pii.both(text, spans, [(2, 0, 8), (3, 1, 5)]) == spans


def test_quotas():
    allowed = sharding.quotas({(0, 1): 10, (1, 0): 4, (0, 2): 50}, [100, 100, 60], 90)
    assert allowed == {(0, 1): 4, (1, 0): 4, (0, 2): 30}


def test_groups_stay_together(spark):
    rows = [(k, f"text {k % 700}") for k in range(2100)] + [(k, "hot") for k in range(3000, 4000)]
    found = sharding.by_text(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    by_text = {}
    for r in found:
        by_text.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(v) > 1 for v in by_text.values()) <= 0.2 * len(by_text)
    sizes = [sum(r["shard"] == s for r in found) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_pieces_and_collections_take_bounded_memory():
    """A step of text takes some thirty times its bytes; a collection's text does not grow with the input."""
    data = np.random.default_rng(5).integers(97, 123, 2 << 20).astype(np.uint8)
    tracemalloc.start()
    repeats.pieces(data, np.array([0, len(data) // 2, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * len(data)
    for size in (0, 10**6, 6 * 10**9, 30 * 10**9):
        assert size / repeats.bucket_count(size) <= repeats.BUCKET_BYTES
