"""Models without SQL against dense numpy on the smallest event ratings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.functions.encode import hex_number
from tastemill.plans import als, embed, factors, svd
from tastemill.plans.workspace import workspace

from .conftest import lists

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dense(spark):
    events = workspace(spark, FOLDER).events
    users = sorted(r[0] for r in events.users.collect())
    items = sorted(r[0] for r in events.items.collect())
    matrix, seen = np.zeros((len(users), len(items))), np.zeros((len(users), len(items)), bool)
    for r in events.centred.collect():
        at = users.index(r["user_id"]), items.index(r["item_id"])
        matrix[at], seen[at] = r["centred"], True
    return events, users, items, matrix, seen


def best_unseen(users, items, pred, seen, n=10):
    out = {}
    for a, user in enumerate(users):
        rows = [(-np.float32(s), i, s) for s, i, old in zip(pred[a], items, seen[a]) if not old and s >= -1e-12]
        out[user] = [(i, s) for _, i, s in sorted(rows)[:n]]
    return {u: rows for u, rows in out.items() if rows}


def same_lists(got, want):
    assert got.keys() == want.keys()
    """The same scores in order, and the same items but where neighbours tie."""
    for user, rows in want.items():
        assert [s for _, s in got[user]] == pytest.approx([s for _, s in rows], rel=1e-6, abs=1e-9)
        for place, ((a, s), (b, _)) in enumerate(zip(got[user], rows)):
            near = [i for i, t in rows if abs(t - s) <= 1e-6 * max(abs(s), 1e-3)]
            assert a == b or len(near) > 1 or place == len(rows) - 1


@pytest.mark.parametrize("semantics", ["reference", "corrected"])
def test_svd(dense, semantics):
    events, users, items, matrix, seen = dense
    model, sigma = svd.svd(events.centred, events.users, events.items, semantics=semantics)
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    share = np.cumsum(s**2) / np.sum(s**2)
    k = int(np.argmax(share >= 0.8)) + (semantics == "corrected")
    assert model.k == k and sigma[: k + 1] == pytest.approx(s[: k + 1], rel=1e-6)
    pred = (u[:, :k] * s[:k]) @ vt[:k]
    same_lists(lists(factors.recommend_factors(model, events.users, events.items, events.old)), best_unseen(users, items, pred, seen))


def test_svd_by_subspaces(dense):
    """The iteration on a part of the columns finds what the whole basis does."""
    events, users, items, matrix, seen = dense
    model, sigma = svd.svd(events.centred, events.users, events.items, 0.3, semantics="corrected", first_k=12, whole_columns=0)
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    k = int(np.argmax(np.cumsum(s**2) / np.sum(s**2) >= 0.3)) + 1
    assert model.k == k and sigma[:k] == pytest.approx(s[:k], rel=1e-6)
    cells = {(r["user_id"], r["item_id"]): r["pred"] for r in factors.predict_cells(model, events.centred.select("user_id", "item_id")).collect()}
    pred = (u[:, :k] * s[:k]) @ vt[:k]
    assert all(cells[users[a], items[b]] == pytest.approx(pred[a, b], abs=1e-4) for a, b in zip(*np.nonzero(seen)))


def test_als(dense, spark):
    events, users, items, matrix, seen = dense
    k, steps = 5, 3
    model = als.als_dense(events.centred, events.users, events.items, k, steps, 1e-5, 0.1, 0.2)
    texts = spark.createDataFrame([(f, i) for f in range(k) for i in items], "f int, item_id long")
    draws = {(r[0], r[1]): r[2] / 2**32 for r in texts.select("f", "item_id", hex_number(F.concat_ws("-", F.lit("start"), "f", "item_id"), 8)).collect()}
    right = np.array([[draws[f, i] for f in range(k)] for i in items])
    for _ in range(steps):
        left = matrix @ right @ np.linalg.inv(right.T @ right + 0.1 * np.eye(k))
        right = matrix.T @ left @ np.linalg.inv(left.T @ left + 0.2 * np.eye(k))
    loss = ((matrix - left @ right.T) ** 2).sum() + 0.1 * (left**2).sum() + 0.2 * (right**2).sum()
    assert model.losses[-1] == pytest.approx(loss, rel=1e-9)
    same_lists(lists(factors.recommend_factors(model, events.users, events.items, events.old)), best_unseen(users, items, left @ right.T, seen))


def test_embedding(spark, tmp_path):
    """Two groups of items that never share a basket end up close to their own group."""
    rows = []
    for basket in range(400):
        group = range(0, 8) if basket % 2 else range(10, 18)
        rows += [(basket, 1, i, 5) for i in list(group)[basket % 4 : basket % 4 + 5]]
    frame = spark.createDataFrame(rows, "user_id long, basket_no long, item_id long, basket_size long")
    model = embed.train(frame, ["user_id", "basket_no"], 16, 10, epochs=10)
    embed.save(model, str(tmp_path / "model"))
    vectors = embed.item_vectors(embed.load(str(tmp_path / "model")))
    users = spark.createDataFrame([(1,), (2,), (3,), (4,)], "user_id long")
    recent = spark.createDataFrame([(1, 2), (1, 3), (2, 12), (3, 99)], "user_id long, item_id long")
    got = embed.recommend_embedding(recent, vectors, 16, 4)
    found = lists(got)
    assert all(i < 10 for i, _ in found[1]) and all(i >= 10 for i, _ in found[2])
    status = {r[0]: r[1] for r in embed.list_status(users, recent, got, 4).collect()}
    assert status == {1: embed.OK, 2: embed.OK, 3: embed.NOTHING, 4: embed.EMPTY}
    assert {r[0]: r[1] for r in embed.list_status(users, recent, got, 5).collect()}[1] == embed.SHORT
    counts = {r[0]: r[1] for r in embed.status_counts(embed.list_status(users, recent, got, 4)).collect()}
    assert counts == {0: 2, 1: 1, 2: 1}
