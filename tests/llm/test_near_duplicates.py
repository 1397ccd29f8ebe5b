"""The pipeline's near-duplicate stage against brute force on 5-word shingles at 0.8."""

import re

import numpy as np

import corpus_pipeline
from tastemill.llm import jaccard
from tests.llm import brute
from tests.llm.test_contracts import FOLDER

BASE = [f"w{k * 7919 % 9973}" for k in range(200)]


def changed(words, places):
    return " ".join(f"other{k}" if k in places else w for k, w in enumerate(words))


def least_ids(rows, size=5, part=100, whole=80):
    """Smallest id that is reachable by links, for each row."""
    sets = []
    for _, t in rows:
        w = re.findall(brute.SPACE, brute.lower(t))
        sets.append({tuple(w[a : a + size]) for a in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and part * same >= whole * (len(sets[a]) + len(sets[b]) - same):
                parent[top(a)] = top(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), d), d)
    return [least[top(k)] for k in range(len(rows))]


def stage_rows(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(3), FOLDER).collect())


def test_copies_that_three_words_at_nine_tenths_miss(spark):
    """J5 = 176/216 = 0.815 but J3 = 186/210 = 0.886."""
    near, far = changed(BASE, {40, 80, 120, 160}), changed(BASE, {30, 60, 90, 120, 150})
    assert stage_rows(spark, [(1, " ".join(BASE)), (2, near)]) == [(1, " ".join(BASE))]
    assert len(stage_rows(spark, [(1, " ".join(BASE)), (2, far)])) == 2


def test_stage_is_brute_force_at_five_words(spark):
    draw = np.random.default_rng(8)
    found = spark.read.parquet(f"{FOLDER}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text").orderBy("doc_id").collect()
    rows = [(r["doc_id"], r["text"]) for r in found]
    for k in range(60):  # copies around the threshold, and short ones
        n = int(draw.integers(3, 300))
        words = [f"a{k}x{j}" for j in range(n)]
        rows.append((10_000 + 2 * k, " ".join(words)))
        rows.append((10_001 + 2 * k, changed(words, set(draw.choice(n, int(draw.integers(0, max(2, n // 20))), replace=False).tolist()))))
    want = sorted(r for r, least in zip(rows, least_ids(rows)) if r[0] == least)
    assert want != sorted(r for r, least in zip(rows, least_ids(rows, 3, 100, 90)) if r[0] == least)
    assert stage_rows(spark, rows) == want


def test_first_shingles_and_bands_meet_at_the_stages_rule():
    rule = jaccard.NEAR
    for size in range(1, 300):
        for other in range(size, size * rule.part // rule.whole + 1):
            keys, cut = jaccard.meeting_keys(np.array([7, 7], np.uint64), np.array([0, 1, 2]), np.array([size, other]), rule)
            assert set(keys[: cut[1]].tolist()) & set(keys[cut[1] :].tolist())
    draw = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(draw.integers(0, 1 << 60, int(draw.integers(1, 80))).astype(np.uint64))
        b = a[draw.random(len(a)) > 0.15]
        first, cut = jaccard.firsts(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), np.zeros(0, np.uint64), rule)
        if 100 * len(b) >= 80 * len(a) and len(b):
            assert len(np.intersect1d(first[: cut[1]], first[cut[1] :]))


def test_unrelated_long_sets_are_told_apart():
    """In every class of sizes below 1 % of random pairs pass the bound, while links always do."""
    rule, draw = jaccard.NEAR, np.random.default_rng(6)
    for size in (30, 100, 300, 600, 1200, 2500, 5000, 12_000, 40_000):
        band = jaccard.bands(np.array([size]), rule)
        width = int(jaccard.resolutions(band, rule)[0])
        sets = [np.unique(draw.integers(0, 1 << 62, size).astype(np.uint64)) for _ in range(40)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        blobs = jaccard.banded_points(np.concatenate(sets), ends, np.repeat(band, 40), rule)
        assert (jaccard.widths(blobs) == width).all()
        counts = jaccard.unpacked(blobs)
        passed = sum(bool(jaccard.reaches(np.minimum(counts[a], counts[b]).sum(), 2 * size, rule)) for a in range(40) for b in range(a))
        assert passed < 0.01 * 780
        near = np.concatenate([sets[0][: int(0.9 * size)], sets[1][: size - int(0.9 * size)]])
        point = jaccard.points(near, np.array([0, len(near)]), width)[0]
        same = len(np.intersect1d(near, sets[0]))
        assert rule.part * same >= rule.whole * (len(near) + size - same) and jaccard.reaches(np.minimum(point, counts[0]).sum(), len(near) + size, rule)


def test_long_near_copies_among_unrelated_long_texts(spark):
    """Texts of 3,000 words that share a passage, two of them near copies: one class, the others alone."""
    draw = np.random.default_rng(2)
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join(passage + [f"x{v}" for v in draw.integers(0, 1 << 40, 3000)])) for k in range(30)]
    words = rows[4][1].split()
    rows.append((99, changed(words, set(draw.choice(len(words), 60, replace=False).tolist()))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.classes(docs, rule=jaccard.NEAR, together=8).collect()}
    assert found == {**{k: k for k in range(30)}, 99: 4}
