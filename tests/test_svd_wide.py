"""Subspaces that grow until they take all columns, against numpy."""

import numpy as np
import pytest

from tastemill.plans import factors, svd
from tests.test_brute_force import dense  # noqa: F401


@pytest.mark.parametrize("ratio", [1.5, 0.8])
def test_svd_that_needs_most_components(dense, ratio):  # noqa: F811
    events, users, items, matrix, seen = dense
    model, sigma = svd.svd(events.centred, events.users, events.items, ratio, semantics="corrected", first_k=12, whole_columns=0)
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    reached = np.cumsum(s**2) / np.sum(s**2) >= ratio
    k = int(np.argmax(reached)) + 1 if reached.any() else len(s)
    n = min(k, len(s), len(sigma))
    assert n == min(k, len(s)) and sigma[:n] == pytest.approx(s[:n], rel=1e-6, abs=1e-6)
    cells = {(r["user_id"], r["item_id"]): r["pred"] for r in factors.predict_cells(model, events.centred.select("user_id", "item_id")).collect()}
    pred = (u[:, :k] * s[:k]) @ vt[:k]
    assert all(cells[users[a], items[b]] == pytest.approx(pred[a, b], abs=1e-4) for a, b in zip(*np.nonzero(seen)))
