"""The routes for hot keys and oversized groups give the same results as the plain ones."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tastemill.operators import baskets, cooccur, dense_top, mean_shift, quantile, rank, skew, split
from tastemill.operators.spmm import SparseMatrix
from tastemill.plans import item_cf, rules, walk
from tastemill.session import stage

from . import test_tiny as T
from .conftest import DAY, lists, sets


@pytest.fixture
def every_key_is_hot(monkeypatch):
    monkeypatch.setattr(skew, "SPLIT_ROWS", 1)


@pytest.fixture(scope="module")
def busy(spark):
    """One user with a third of all rows, and many small ones; whole seconds."""
    rng = np.random.default_rng(5)
    rows = [(0, i, int(t)) for i, t in enumerate(rng.integers(0, 400 * DAY, 300))]
    for user in range(1, 40):
        rows += [(user, i, int(t)) for i, t in enumerate(rng.integers(0, 200 * DAY, rng.integers(1, 30)))]
    return stage(spark.createDataFrame(rows, "user_id long, item_id long, ts long"), "busy")


def test_quantile_in_two_steps(busy):
    want = {r["user_id"]: r["cut"] for r in quantile.group_quantile(busy, "user_id", "ts", 0.8).collect()}
    for limit in (1, 50):
        got = {r["user_id"]: r["cut"] for r in quantile.group_quantile(busy, "user_id", "ts", 0.8, split_rows=limit).collect()}
        assert got == pytest.approx(want, rel=1e-15)
    times = {}
    for r in busy.collect():
        times.setdefault(r["user_id"], []).append(r["ts"])
    assert want == pytest.approx({u: np.quantile(t, 0.8) for u, t in times.items()})


def test_salted_lookup(busy):
    names = busy.groupBy("user_id").agg(F.max("ts").alias("last"))
    plain = sorted(map(tuple, busy.join(names, "user_id").collect()))
    hot = skew.hot_keys(busy, "user_id", 50)
    assert [(r["user_id"], r["_parts"]) for r in hot.collect()] == [(0, 6)]
    salted = skew.lookup(busy, names, "user_id", ["item_id"], split_rows=50)
    assert sorted(map(tuple, salted.select(*busy.columns, "last").collect())) == plain
    parts = skew.salt_rows(busy, hot, "user_id", ["item_id"]).where("user_id = 0").select("_salt").distinct()
    assert parts.count() == 6


def slow_mean_shift(times, bandwidth):
    """Point by point, straight from the definition."""
    points = np.asarray(times, float)
    found = {}
    for seed in points:
        centre = seed
        for _ in range(301):
            near = points[np.abs(points - centre) <= bandwidth]
            mean, moved = near.mean(), abs(near.mean() - centre)
            centre = mean
            if moved < 1e-3 * bandwidth:
                break
        found[round(centre, 4)] = (len(near), centre)
    kept = []
    for _, centre in sorted(found.values(), reverse=True):
        if all(abs(centre - k) > bandwidth for k in kept):
            kept.append(centre)
    return kept, [int(np.argmin([abs(p - k) for k in kept])) for p in points]


@pytest.mark.parametrize("limit", [500_000, 100, 1])
def test_mean_shift(busy, limit):
    got = {}
    for r in mean_shift.mean_shift_labels(busy, 25, limit).collect():
        got.setdefault(r["user_id"], {})[r["item_id"]] = r["centre"]
    users = {}
    for r in busy.collect():
        users.setdefault(r["user_id"], []).append((r["item_id"], r["ts"]))
    for user, rows in users.items():
        if len(rows) < 2:
            if limit > 1:
                assert user not in got
            continue
        kept, labels = slow_mean_shift([t for _, t in rows], 25 * DAY)
        want = {item: kept[label] for (item, _), label in zip(rows, labels)}
        assert got[user] == pytest.approx(want, abs=1e-3), user


def test_gap_baskets(busy, every_key_is_hot):
    got = {}
    for r in baskets.gap_baskets(busy, 5).collect():
        got.setdefault((r["user_id"], r["basket_no"]), set()).add(r["item_id"])
        assert r["basket_size"] > 1
    want, times = set(), {}
    for r in busy.collect():
        times.setdefault(r["user_id"], []).append((r["ts"], r["item_id"]))
    for user, rows in times.items():
        rows.sort()
        group = [rows[0]]
        for row in rows[1:] + [(10**12, -1)]:
            if row[0] - group[-1][0] > 5 * DAY:
                if len(group) > 1:
                    want.add((user, frozenset(i for _, i in group)))
                group = []
            group.append(row)
    assert {(u, frozenset(items)) for (u, _), items in got.items()} == want


def test_chunked_pairs(busy):
    sized = baskets.gap_baskets(busy, 25)
    keys = ["user_id", "basket_no"]
    want = sorted(map(tuple, cooccur.cooccurrence(sized, keys).collect()))
    for chunk in (1, 3, 10):
        assert sorted(map(tuple, cooccur.cooccurrence(sized, keys, chunk).collect())) == want


def test_sparse_product(busy):
    entries = busy.withColumn("v", (F.col("ts") % 7).cast("double"))
    block = stage(busy.select("item_id").distinct().withColumn("vec", F.array(F.col("item_id") * 1.0, F.lit(1.0))), "block")
    plain, salted = SparseMatrix(entries, "user_id", "item_id", "v"), SparseMatrix(entries, "user_id", "item_id", "v", 20)
    assert plain.hot["user_id"] is None and salted.hot["user_id"] is not None and salted.hot["item_id"] is not None
    for call in ("times", "transposed_times"):
        key = "user_id" if call == "times" else "item_id"
        source = block if call == "times" else block.withColumnRenamed("item_id", "user_id")
        got = {r[key]: r["vec"] for r in getattr(salted, call)(source, 2).collect()}
        want = {r[key]: r["vec"] for r in getattr(plain, call)(source, 2).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_sliced_catalogue(spark):
    """However many blocks, each row has n unseen items of each, and the lists are those of the whole."""
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(u, rng.integers(-2, 3, 3).astype(float).tolist()) for u in range(30)], "user_id long, vec array<double>")
    seen = {u: {int(i) for i in rng.integers(0, 200, u)} for u in range(30)}
    pairs = spark.createDataFrame([(u, i) for u, items in seen.items() for i in items], "user_id long, item_id long")
    cat = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(200)]
    catalogue = stage(spark.createDataFrame(cat, "item_id long, vec array<double>"), "catalogue")
    matrix = np.array([v for _, v in cat])
    for size, blocks in ((2**26, 1), (1000, 7)):
        found = dense_top.dense_candidates(rows, catalogue, "user_id", "item_id", 5, 3, 0.0, pairs, size)
        assert found.count() <= 30 * 5 * blocks
        got = lists(rank.top_n(found, 5))
        assert sum(map(len, got.values())) == 30 * 5
        for r in rows.collect():
            scores = matrix @ np.array(r["vec"])
            order = [(int(i), float(scores[i])) for i in np.lexsort((np.arange(200), -scores)) if scores[i] >= 0 and i not in seen[r["user_id"]]][:5]
            assert got[r["user_id"]] == order


def test_zero_items_beyond_the_head(spark, monkeypatch):
    items = spark.createDataFrame([(i,) for i in range(100)], "item_id long")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    taken = spark.createDataFrame([(1, i) for i in range(90)] + [(2, 0)], "user_id long, item_id long")
    scored = spark.createDataFrame([(1, 95, 2.0), (2, 50, -1.0)], "user_id long, item_id long, score double")
    every = taken.unionByName(scored.select("user_id", "item_id"))
    monkeypatch.setattr(rank, "SPAN", 8)
    got = lists(rank.top_n_with_zeros(scored, every, users, items, 3))
    assert got == {1: [(95, 2.0), (90, 0.0), (91, 0.0)], 2: [(1, 0.0), (2, 0.0), (3, 0.0)], 3: [(0, 0.0), (1, 0.0), (2, 0.0)]}


def test_first_free_items(spark, monkeypatch):
    """Free items by score and id, whatever is taken, with spans of any length."""
    rng = np.random.default_rng(3)
    scores = [float(s) for s in rng.integers(0, 9, 60)]
    catalogue = spark.createDataFrame(list(enumerate(scores)), "item_id long, score double")
    taken = {u: sorted({int(i) for i in rng.integers(0, 60, 12 * u)}) for u in range(9)}
    rows = spark.createDataFrame([(u, i) for u, items in taken.items() for i in items], "user_id long, item_id long")
    users = spark.createDataFrame([(u,) for u in range(9)], "user_id long")
    ranked = sorted(range(60), key=lambda i: (-scores[i], i))
    for span in (1, 7, 1024):
        monkeypatch.setattr(rank, "SPAN", span)
        got = lists(rank.top_n(rank.first_free(catalogue, rows, users, 6), 6))
        want = {u: [(i, scores[i]) for i in ranked if i not in taken[u]][:6] for u in range(9)}
        assert got == {u: w for u, w in want.items() if w}


def test_pipelines_with_hot_keys(tiny, every_key_is_hot):
    """Golden lists again, with every key above the split size."""
    cut = split.with_cut(tiny.ratings)
    assert sets(split.old_part(cut)) == sets(tiny.old)
    centred = stage(split.centred(tiny.old), "centred")
    model = item_cf.ItemCF(centred, T.tiny_baskets(tiny), 2)
    T.near(lists(item_cf.recommend_rated(model)), T.RATED_LISTS)
    T.near(lists(item_cf.recommend_unrated(model, tiny.users, tiny.items)), T.UNRATED_LISTS)
    found = rules.frequent_itemsets(T.tiny_baskets(tiny), ["user_id", "basket_no"], 0.08)
    low = lists(rules.recommend_by_rules(split.recent_items(tiny.old), rules.association_rules(found, 0.2)))
    assert low[1] == [(2, 1.0), (3, 1.0), (5, 1.0)]


def test_blocked_product(tiny, monkeypatch):
    """Unrated item CF in the smallest cells: one user, few targets and sums at a time."""
    for name in ("CELL_RATINGS", "CELL_WEIGHTS", "CELL_SUMS"):
        monkeypatch.setattr(item_cf, name, 1)
    model = item_cf.ItemCF(tiny.centred, T.tiny_baskets(tiny))
    T.near(lists(item_cf.recommend_unrated(model, tiny.users, tiny.items)), T.UNRATED_LISTS)


def test_blocked_product_is_the_plain_one(spark, monkeypatch):
    """Random ratings and baskets, some of them large, against sums in plain Python; n rows per user and block."""
    rng = np.random.default_rng(9)
    rated = {(int(u), int(i)): float(c) for u, i, c in zip(rng.integers(0, 25, 220), rng.integers(0, 40, 220), rng.normal(0, 1, 220).round(3))}
    rows = {(int(b), int(i)) for b, i in zip(rng.integers(0, 30, 160), rng.integers(0, 40, 160))} | {(99, i) for i in range(0, 40, 2)}
    size = {b: sum(x == b for x, _ in rows) for b, _ in rows}
    ratings = stage(spark.createDataFrame([(u, i, 1.0, 0, c) for (u, i), c in rated.items()], "user_id long, item_id long, rating double, ts long, centred double"), "r")
    baskets = stage(spark.createDataFrame([(b, 0, i, size[b]) for b, i in rows], "user_id long, basket_no long, item_id long, basket_size long"), "b")
    raters = {i: sum(x == i for _, x in rated) for i in range(40)}
    weight = {}
    for b in size:
        held = [i for x, i in rows if x == b]
        for i in held:
            for j in held:
                if i != j and raters[i] and raters[j]:
                    weight[i, j] = weight.get((i, j), 0) + 1 / (raters[i] * raters[j]) ** 0.5
    want = {}
    for (u, j), c in rated.items():
        for (i, k), w in weight.items():
            if k == j and (u, i) not in rated:
                want[u, i] = want.get((u, i), 0.0) + w * c
    for chunk, ratings_of, weights_of, sums in ((256, 2_000_000, 4_000_000, 2_000_000), (8, 30, 20, 50)):
        monkeypatch.setattr(item_cf, "CELL_RATINGS", ratings_of)
        monkeypatch.setattr(item_cf, "CELL_WEIGHTS", weights_of)
        monkeypatch.setattr(item_cf, "CELL_SUMS", sums)
        model = item_cf.ItemCF(ratings, baskets, chunk)
        assert model.has_large == (chunk == 8)
        got = {(r["user_id"], r["item_id"]): r["score"] for r in model.predict_unrated().collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        best = model.predict_unrated(top=2).collect()
        lists_of = lists(rank.top_n(spark.createDataFrame(best), 2))
        for u in range(25):
            mine = sorted(((-np.float32(s), i) for (v, i), s in want.items() if v == u and s > 1e-12))[:2]
            assert [i for i, _ in lists_of.get(u, [])] == [i for _, i in mine]
        assert len(best) < len(want)


def test_a_cell_works_where_there_are_neighbours():
    """60,000 users and targets with one neighbour each: as many products, not users x targets."""
    n = 60_000
    of = lambda kind, ids, others, values: {"kind": [kind] * n, "id": ids, "ids": [[i] for i in others], "values": [[v] for v in values]}
    near = of(item_cf.NEAR, range(n), range(n, 2 * n), [0.5] * n)
    mine = of(item_cf.VALUES, range(n), range(n), [float(u % 7 - 2) for u in range(n)])
    shape = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("ids", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))])
    table = pa.table({c: [*near[c], *mine[c]] for c in shape.names}, shape)
    for held in (item_cf.CELL_SUMS, 1000):
        got = item_cf._cell(table, 2, held).to_pydict()
        want = [u for u in range(n) if u % 7 > 2]
        assert got["user_id"] == want and got["item_id"] == [n + u for u in want] and got["score"] == [0.5 * (u % 7 - 2) for u in want]
        assert item_cf._cell(table, None, held).num_rows == n


def test_walk_from_either_side(tiny):
    """Few sources use the user side, many the item side; the scores agree."""
    edges = walk.graph_edges(tiny.centred)
    one = {(r[0], r[1]): r[2] for r in walk.walk_scores(edges, tiny.users.where("user_id = 3"), tolerance=1e-7).collect()}
    graph = stage(edges.unionByName(edges.withColumn("user_id", F.col("user_id") + 10)), "double")
    many = {(r[0], r[1]): r[2] for r in walk.walk_scores(graph, graph.select("user_id").distinct(), block=2).collect()}
    deg = np.zeros((8, 4))
    users, items = [1, 2, 3, 4, 11, 12, 13, 14], [1, 2, 3, 6]
    for r in graph.collect():
        deg[users.index(r["user_id"]), items.index(r["item_id"])] = 1
    adj = np.block([[np.zeros((8, 8)), deg], [deg.T, np.zeros((4, 4))]])
    full = np.linalg.inv(np.eye(12) - 0.8 * (adj / adj.sum(axis=1, keepdims=True)).T)
    want = {(u, s): full[a, 8 + b] for a, u in enumerate(users) for b, s in enumerate(items) if full[a, 8 + b] > 1e-12}
    assert many == pytest.approx(want, abs=1e-10)
    assert one[3, 2] == pytest.approx(1.525054, abs=1e-6)
