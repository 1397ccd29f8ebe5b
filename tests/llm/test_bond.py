"""Hard negatives against plain Python, over odd rows and small blocks."""

import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tastemill.llm import bond

SCHEMA = "vec_id long, label int, embedding array<float>, `row` string, id string, score int"


def plain(rows, task=bond.Task(), every=50):
    kept = []
    for vec_id, label, vec in rows:
        if None in (vec_id, label, vec) or any(x is None or not math.isfinite(x) for x in vec):
            continue
        kept.append((vec_id, label, [math.floor(256 * x) for x in vec]))
    out = []
    for k, (vec_id, label, vec) in enumerate(kept):
        if vec_id % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vec, v)), i, same) for j, (i, l, v) in enumerate(kept) if j != k for same in [l == label])
        positives = [(i, -s) for s, i, same in scored if same][: task.positives]
        for positive, score in positives:
            inside = [(i, -s) for s, i, same in scored if not same and task.least * score <= -s <= task.most * score]
            out += [(vec_id, positive, rank, i, score, s) for rank, (i, s) in enumerate(inside[: task.negatives], 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in bond.mine(df, F.col("vec_id") % 50 == 0, **more).collect())


def vectors(count, width, seed, labels=3, spread=1.0, shift=0.0):
    rng = random.Random(seed)
    near = lambda: float(np.float32(rng.gauss(shift, spread)))
    return [(10 * k, rng.randrange(labels), [near() for _ in range(width)]) for k in range(count)]


ODD = [
    (None, 1, [1.0, 2.0]), (50, None, [1.0, 2.0]), (100, 1, None), (150, 1, [None, 1.0]), (200, 1, [float("nan"), 1.0]), (250, 1, [float("inf"), 1.0]),
    (300, 1, []), (300, 1, []), (350, 1, [1.0]), (351, 1, [0.5, 3.0]), (352, 2, [0.9]), (353, 2, [0.9, 5.0]), (354, 2, [0.9]), (355, 2, [0.9]), (355, 2, [0.9]),
    (-50, 2, [0.0]), (-51, 2, [0.0]), (-52, 1, [0.0]), (400, 7, [1.0, 1.0]), (450, 1, [-1.0, -1.0]), (451, 1, [1.0, 1.0]),
]


@pytest.mark.parametrize(
    "rows",
    [
        vectors(300, 11, 1),
        vectors(300, 24, 2, shift=0.7),
        vectors(200, 4, 3, labels=1),
        [(k, k % 3, [0.25 * (k % 2), 0.5]) for k in range(400)],  # very many equal vectors
        vectors(100, 5, 4, spread=1e5),
        ODD,
        ODD + vectors(120, 9, 5, shift=0.5),
    ],
    ids=["random", "pruned", "one label", "copies", "large", "odd", "odd among others"],
)
def test_like_plain_python(spark, rows):
    got = mined(spark, rows, block=37, group=4)
    assert got == plain(rows)


def test_rows_that_repeat_an_id(spark):
    rows = [(50, 1, [1.0, 0.5])] * 3 + [(51, 2, [0.9, 0.1]), (51, 2, [0.9, 0.1]), (52, 2, [0.8, 0.2])]
    assert mined(spark, rows) == plain(rows)


def test_other_windows(spark):
    task = bond.Task(2, 1, Fraction(1, 4), Fraction(1, 2))
    rows = vectors(150, 6, 9, shift=0.4)
    assert mined(spark, rows, task=task, block=20, group=3) == plain(rows, task)


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == []


def test_bounds_rule_out_and_lose_none():
    """The scan leaves few candidates, and the best are always among them."""
    rng = np.random.default_rng(1)
    columns = np.floor(rng.normal(0, 40, (64, 3000)))
    columns[:4] *= 20  # a few heavy dimensions, as BOND wants
    anchor = np.floor(rng.normal(0, 40, 64))
    anchor[:4] *= 20
    limits = columns.min(axis=1), columns.max(axis=1)
    exact = anchor @ columns
    alive, score = bond.scan(columns, limits, anchor, np.arange(3000), bond.among_best(5))
    assert set(np.argsort(-exact)[:5]) <= set(alive) and (score == exact[alive]).all() and len(alive) < 300
    low, high = int(np.quantile(exact, 0.5)), int(np.quantile(exact, 0.6))
    alive, score = bond.scan(columns, limits, anchor, np.arange(3000), bond.among_windows([(low, high)], 3))
    inside = np.flatnonzero((exact >= low) & (exact <= high))
    assert set(inside[np.argsort(-exact[inside])][:3]) <= set(alive) and len(alive) < 600


def test_exact_beyond_float64():
    huge = np.array([[1 << 28, 3], [(1 << 28) - 1, 5]])
    columns, anchors = bond.suited(np.ascontiguousarray(huge.T), huge)
    assert columns.dtype == np.int64 and int((anchors[1] @ columns)[0]) == ((1 << 28) - 1) * (1 << 28) + 15
    with pytest.raises(ValueError):
        bond.suited(np.array([[1 << 31]]), np.array([[1 << 31]]))
    assert bond.matrix(pa.array([[1], [], [2, 3]], pa.list_(pa.int64()))).tolist() == [[1, 0], [0, 0], [2, 3]]
