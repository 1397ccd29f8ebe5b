"""Golden values on the hand-made fixture."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.functions.vectors import unit
from tastemill.operators import baskets as B, cooccur, cosine, features, mean_shift, skew, split
from tastemill.plans import als, evaluate as ev, factors, item_cf, lottery, popular, rules, svd, walk
from tastemill.session import stage

from .conftest import DAY, lists, sets


def near(got, want, tol=2e-6):
    assert {u: [i for i, _ in row] for u, row in got.items()} == {u: [i for i, _ in row] for u, row in want.items()}
    for user, row in want.items():
        assert [s for _, s in got[user]] == pytest.approx([s for _, s in row], abs=tol)


def test_split(tiny):
    assert sets(tiny.old) == {1: {1, 2, 3, 4}, 2: {1, 2, 3}, 3: {2, 3, 4, 5}, 4: {6}}
    assert sets(tiny.new) == {1: {5}, 2: {6}, 3: {6}, 4: {6}}
    cuts = {r["user_id"]: r["cut"] / DAY for r in split.with_cut(tiny.ratings).collect()}
    assert cuts == pytest.approx({1: 52, 2: 60.4, 3: 3.2, 4: 5})
    assert sets(split.new_part(split.with_cut(tiny.ratings), "corrected")) == {1: {5}, 2: {6}, 3: {6}}


def test_recent_and_means(tiny):
    assert sets(split.recent_items(tiny.old)) == {1: {4}, 2: {3}, 3: {5}}
    means = {r["user_id"]: r["user_mean"] for r in split.user_means(tiny.old).collect()}
    assert means == pytest.approx({1: 3.25, 2: 11 / 3, 3: 3, 4: 5})


def test_hot(tiny):
    hot = popular.hot_items(tiny.old, tiny.items)
    assert {r["item_id"]: r["score"] for r in hot.collect()} == {3: 13, 2: 10, 1: 9, 6: 5, 4: 3, 5: 1}
    got = lists(popular.recommend_hot(hot, tiny.users, 4))
    assert got == {u: [(3, 13.0), (2, 10.0), (1, 9.0), (6, 5.0)] for u in range(1, 5)}
    unseen = lists(popular.recommend_hot(hot, tiny.users, 1, tiny.old))
    assert unseen == {1: [(6, 5.0)], 2: [(6, 5.0)], 3: [(1, 9.0)], 4: [(3, 13.0)]}


@pytest.mark.parametrize("limit", [500_000, 1])
def test_mean_shift(tiny, limit):
    old = tiny.old
    labels = mean_shift.mean_shift_labels(old, 25, limit)
    got = {}
    for r in labels.collect():
        got.setdefault((r["user_id"], round(r["centre"] / DAY, 6)), set()).add(r["item_id"])
    assert got == {(1, 1.0): {1, 2, 3}, (1, 40.0): {4}, (2, 5.0): {1, 2}, (2, 60.0): {3}, (3, 1.5): {2, 3, 4, 5}}



def tiny_baskets(tiny):
    return mean_shift.mean_shift_baskets(tiny.old, 25)


def test_item_cf(tiny):
    baskets = tiny_baskets(tiny)
    arrays = {tuple(r["items"]) for r in B.basket_lists(baskets, ["user_id", "basket_no"]).collect()}
    assert arrays == {(1, 2, 3), (1, 2), (2, 3, 4, 5)}
    raters = cooccur.item_raters(tiny.old)
    assert {r[0]: r[1] for r in raters.collect()} == {1: 2, 2: 3, 3: 3, 4: 2, 5: 1, 6: 1}
    w = cooccur.purchase_similarity(baskets, raters)
    want = {(1, 2): 0.816497, (1, 3): 0.408248, (2, 3): 0.666667, (2, 4): 0.408248,
            (2, 5): 0.577350, (3, 4): 0.408248, (3, 5): 0.577350, (4, 5): 0.707107}
    assert {(r["i"], r["j"]): r["w"] for r in w.collect()} == pytest.approx(want, abs=1e-6)


RATED_LISTS = {
    1: [(1, 1.852062), (2, 0.760310), (3, 0.379209), (4, -2.045876)],
    2: [(3, 0.358305), (1, -0.483163), (2, -0.505612)],
    3: [(2, 1.103718), (3, 0.770385), (5, -0.975056), (4, -1.189469)],
    4: [(6, 0.0)],
}
UNRATED_LISTS = {
    1: [(6, 0.0), (5, -1.302315)],
    2: [(6, 0.0), (4, -0.136083), (5, -0.192450)],
    3: [(1, 2.041241), (6, 0.0)],
    4: [(i, 0.0) for i in range(1, 6)],
}


@pytest.mark.parametrize("chunk", [256, 3, 2, 1])
def test_item_cf_lists(tiny, chunk):
    """The result is the same whichever of the three routes carries the sum."""
    model = item_cf.ItemCF(tiny.centred, tiny_baskets(tiny), chunk)
    near(lists(item_cf.recommend_rated(model)), RATED_LISTS)
    near(lists(item_cf.recommend_unrated(model, tiny.users, tiny.items)), UNRATED_LISTS)


def test_rules(tiny):
    baskets = tiny_baskets(tiny)
    found = rules.frequent_itemsets(baskets, ["user_id", "basket_no"], 0.08)
    support = {tuple(r["items"]): r["support"] for r in found.collect()}
    assert support[(2,)] == 1
    for items in [(1,), (3,), (1, 2), (2, 3)]:
        assert support[items] == pytest.approx(2 / 3)
    every = rules.association_rules(found, 0.2)
    assert every.count() == 60
    assert every.where(F.size("consequent") == 1).count() == 35
    assert rules.association_rules(found, 0.2, "corrected").count() == 35
    recent = split.recent_items(tiny.old)
    low = lists(rules.recommend_by_rules(recent, every))
    half, one = 0.5, 1.0
    assert low == {
        1: [(2, one), (3, one), (5, one)],
        2: [(1, half), (2, half), (4, half), (5, half)],
        3: [(2, one), (3, one), (4, one)],
    }
    high = lists(rules.recommend_by_rules(recent, rules.association_rules(found, 0.2, "corrected"), semantics="corrected"))
    assert high[2] == [(2, one), (1, half), (4, half), (5, half)]


def test_rules_for_packed_users(spark, monkeypatch):
    """Recent items that pack into one small file are met with the rules by many tasks; joined rules give the same."""
    recent = stage(spark.range(8000).select((F.col("id") % 4000).alias("user_id"), (F.col("id") % 5).alias("item_id")).coalesce(1), "recent")
    leads = [([i], [(i + 1) % 5], 0.1, 0.2 + i / 10) for i in range(5)] + [([0, 1], [3], 0.1, 0.9)]
    found = spark.createDataFrame(leads, "antecedent array<long>, consequent array<long>, support double, confidence double")
    parts, real = [], rules.top_n
    monkeypatch.setattr(skew, "DEAL_ROWS", 100)
    monkeypatch.setattr(rules, "top_n", lambda scores, n: parts.append(scores.withColumn("_part", F.spark_partition_id())) or real(scores, n))
    held = lists(rules.recommend_by_rules(recent, found))
    assert parts[0].select("_part").distinct().count() > 8
    monkeypatch.setattr(rules, "HELD_LEADS", 0)
    assert lists(rules.recommend_by_rules(recent, found)) == held
    of = {u: {i for i in range(5) if any((x % 4000, x % 5) == (u, i) for x in (u, u + 4000))} for u in range(20)}
    for u, items in of.items():
        want = {}
        for antecedent, (item,), _, confidence in leads:
            if set(antecedent) <= items:
                want[item] = min(confidence, want.get(item, 2))
        assert dict(held[u]) == want


@pytest.mark.parametrize("split", [2_000_000, 3])
def test_pairs_are_not_written_with_vectors(spark, monkeypatch, split):
    """Only ids are staged, also where an item has very many pairs; repeated pairs stay."""
    written, real = [], cosine.stage
    monkeypatch.setattr(cosine, "stage", lambda df, label: written.append(df.columns) or real(df, label))
    monkeypatch.setattr(skew, "SPLIT_ROWS", split)
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "item_id long, vec array<double>")
    wanted = [(i, j) for i in range(6) for j in (5, 5, i)] + [(7, 1), (1, None)]
    got = sorted((r["i"], r["j"], r["sim"]) for r in cosine.pair_cosine(spark.createDataFrame(wanted, "i long, j long"), vectors).collect())
    assert got == sorted((i, j, i * j + 1.0) for i, j in wanted[:-2])
    assert written == [["i", "j"]]


def test_walk(tiny):
    edges = walk.graph_edges(tiny.centred)
    assert sets(edges) == {1: {1, 3}, 2: {1, 3}, 3: {2, 3}, 4: {6}}
    pair = [(1, 0.936819), (3, 0.740741), (2, 0.348584)]
    want = {1: pair, 2: pair, 3: [(2, 1.525054), (3, 0.740741), (1, 0.348584)], 4: [(6, 2.222222)]}
    got = lists(walk.recommend_walk(walk.walk_scores(edges, tiny.users, tolerance=1e-7), tiny.users, tiny.items))
    near({u: [e for e in row if e[1] > 0] for u, row in got.items()}, want)
    assert all(len(row) == 6 for row in got.values())
    other = lists(walk.recommend_walk(walk.walk_scores(edges, tiny.users, tolerance=1e-7, semantics="corrected", block=3), tiny.users, tiny.items, 3))
    near({1: other[1], 3: other[3]}, {1: [(3, 1.111111), (1, 0.936819), (2, 0.174292)], 3: [(3, 1.111111), (2, 0.762527), (1, 0.348584)]})


def test_svd(tiny):
    model, sigma = svd.svd(tiny.centred, tiny.users, tiny.items)
    assert list(sigma[:3]) == pytest.approx([3.460143, 2.953505, 1.649509], abs=1e-6)
    assert model.k == 1
    got = lists(factors.recommend_factors(model, tiny.users, tiny.items, tiny.old))
    near(got, {1: [(6, 0.0)], 2: [(4, 0.127019), (5, 0.096145), (6, 0.0)], 3: [(1, 0.814360), (6, 0.0)], 4: [(i, 0.0) for i in range(1, 6)]})
    error = ev.rmse(model, tiny.new, split.user_means(tiny.old)).first()[0]
    assert error == pytest.approx(0.619484, abs=1e-6)
    assert svd.svd(tiny.centred, tiny.users, tiny.items, semantics="corrected")[0].k == 2
    assert svd.energy(sigma[:3], (sigma**2).sum()) == pytest.approx([0.511285, 0.883806, 1], abs=1e-6)


def start(key, k):
    value = F.lit(1.0) if key == "user_id" else F.col(key) / 10
    return F.array(value)


@pytest.mark.parametrize(
    "semantics, items, loss",
    [
        ("corrected", [-1.037532, -1.595846, -1.093364, 2.163464, 1.563277, 0], 12.905578),
        ("reference", [-1.037532, 0.2, 0.3, 0.4, 0.5, 0.6], 21.565756),
    ],
)
def test_als(tiny, semantics, items, loss):
    model = als.als_dense(tiny.centred, tiny.users, tiny.items, 1, 1, lambda_u=0.1, lambda_i=0.1, semantics=semantics, start=start)
    assert model.losses == pytest.approx([29.847667, loss], abs=1e-5)
    got = {r[0]: r[1][0] for r in factors.complete(model.items, tiny.items, "item_id", 1).collect()}
    assert [got[i] for i in range(1, 7)] == pytest.approx(items, abs=1e-6)
    user = {r[0]: r[1][0] for r in factors.complete(model.users, tiny.users, "user_id", 1).collect()}
    assert [user[i] for i in range(1, 5)] == pytest.approx([-0.544554, 0.099010, -0.693069, 0], abs=1e-6)


def test_als_loss_never_rises(tiny):
    losses = als.als_dense(tiny.centred, tiny.users, tiny.items, 2, 4).losses
    assert len(losses) == 5 and all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))


def all_cosines(vectors, key="item_id"):
    ids = [r[0] for r in vectors.select(key).collect()]
    pairs = vectors.sparkSession.createDataFrame([(i, j) for i in ids for j in ids], "i long, j long")
    return {(r["i"], r["j"]): r["sim"] for r in cosine.pair_cosine(pairs, vectors, key).collect()}


def test_features_and_cosine(tiny):
    full = features.impute(tiny.genres, tiny.tags)
    tags = {r["item_id"]: r["tags"] for r in full.collect()}
    assert tags[6] == pytest.approx([0.85, 0.15])
    vectors = features.unit_vectors(full)
    want = {(1, 2): 0.995082, (1, 3): 0.098901, (1, 4): 0.149816, (1, 5): 0.703211, (1, 6): 0.998819,
            (2, 3): 0.148690, (2, 4): 0.187120, (2, 5): 0.731925, (2, 6): 0.998720, (3, 4): 0.988787,
            (3, 5): 0.703211, (3, 6): 0.123449, (4, 5): 0.741399, (4, 6): 0.168302, (5, 6): 0.718164}
    matrix = all_cosines(vectors)
    assert len(matrix) == 36 and all(matrix[i, i] == pytest.approx(1) for i in range(1, 7))
    assert {p: matrix[p] for p in want} == pytest.approx(want, abs=2e-6)
    spark = vectors.sparkSession
    pairs = cosine.pair_cosine(spark.createDataFrame(list(want), "i long, j long"), vectors)
    assert {(r["i"], r["j"]): r["sim"] for r in pairs.collect()} == pytest.approx(want, abs=2e-6)
    best = {r["i"]: r["j"] for r in cosine.most_similar(vectors, 1, 4).collect()}
    assert best == {1: 6, 2: 6, 3: 4, 4: 3, 5: 4, 6: 1}


def test_user_cosine(spark):
    rows = [(1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.5]), (3, [1.0, 0.5, 1.0]), (4, [0.0, 0.5, 0.0])]
    users = spark.createDataFrame(rows, "user_id long, raw array<double>").select("user_id", unit(F.col("raw")).alias("vec"))
    got = all_cosines(users, "user_id")
    assert all(got[1, j] == 0 for j in range(1, 5))
    assert [got[2, 3], got[2, 4], got[3, 4]] == pytest.approx([0.888889, 0.666667, 0.333333], abs=1e-6)


def test_impute_tiers(spark):
    genres = spark.createDataFrame(
        [(1, [1.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])], "item_id long, genre_vec array<double>"
    )
    tags = spark.createDataFrame([(1, [1.0]), (3, [3.0])], "item_id long, tags array<double>")
    assert {r[0]: r["tags"] for r in features.impute(genres, tags).collect()}[2] == [2.0]
    assert {r[0]: r["tags"] for r in features.impute(genres, tags, "corrected").collect()}[2] == [1.0]


def test_evaluate(tiny):
    vectors = features.unit_vectors(features.impute(tiny.genres, tiny.tags))
    hot = popular.hot_items(tiny.old, tiny.items)
    four = ev.evaluate(popular.recommend_hot(hot, tiny.users, 4), tiny.new, tiny.items, vectors).first()
    assert (four["hits"], four["listed"], four["selected"]) == (3, 16, 4)
    assert (four["precision"], four["recall"], four["f_measure"], four["coverage"]) == (0.1875, 0.75, 0.3, 0.666667)
    assert four["diversity"] == pytest.approx(-0.121221, abs=2e-6)
    right = ev.evaluate(popular.recommend_hot(hot, tiny.users, 4), tiny.new, tiny.items, vectors, "corrected").first()
    assert right["diversity"] == pytest.approx(0.439390, abs=2e-6)
    three = ev.evaluate(popular.recommend_hot(hot, tiny.users, 3), tiny.new, tiny.items, vectors).first()
    assert (three["precision"], three["recall"], three["f_measure"]) == (0, 0, None)


def test_random(tiny):
    got = lists(lottery.recommend_random(tiny.items, tiny.users, 4, "s"))
    assert all(len({i for i, _ in row}) == 4 for row in got.values()) and len(got) == 4
    everything = lists(lottery.recommend_random(tiny.items, tiny.users, 10))
    assert all({i for i, _ in row} == set(range(1, 7)) for row in everything.values())
    assert got == lists(lottery.recommend_random(tiny.items, tiny.users, 4, "s"))


def test_dissimilar(tiny):
    model, _ = svd.svd(tiny.centred, tiny.users, tiny.items, semantics="corrected")
    vectors = features.unit_vectors(features.impute(tiny.genres, tiny.tags))
    got = lists(factors.recommend_dissimilar(model, tiny.users, tiny.items, tiny.old, vectors))
    free = lists(factors.recommend_factors(model, tiny.users, tiny.items, tiny.old))
    sims = all_cosines(vectors)
    pred = {(r["user_id"], r["item_id"]): r["pred"] for r in factors.predict_cells(model, tiny.old).collect()}
    want = {}
    for user, row in free.items():
        liked = [i for (u, i), p in pred.items() if u == user and round(p, 9) >= 0]
        keep = [e for e in row if all(sims[e[0], j] < 0.8 for j in liked)]
        if keep:
            want[user] = keep
    near(got, want)


def test_step_weights():
    weights = walk.step_weights(0.8, 1e-12)
    assert len(weights) < 25 and np.isclose(weights[-1], 1.0628, atol=1e-3)
