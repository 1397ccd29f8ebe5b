"""Exact samples by threshold: the rows that numbering all keys would give, without a shuffle of rows."""

import hashlib

from tastemill.operators import sampling


def test_threshold_is_the_numbering(spark, monkeypatch):
    ids = [7 * k for k in range(700)]
    df = spark.createDataFrame([(k, f"t{k}") for k in ids] + [(None, "none")], "item_id long, title string").repartition(4)
    order = sorted(ids, key=lambda k: (hashlib.md5(f"{k}s".encode()).hexdigest(), k))
    for few in (100_000, 1):
        monkeypatch.setattr(sampling, "FEW_KEYS", few)
        monkeypatch.setattr(sampling, "DIGITS", 3 if few > 1 else 1)
        for fraction in (0.0, 0.0005, 0.1, 0.5, 0.998, 1.0):
            picked = sampling.sample_exact(df, "item_id", fraction, "s")
            assert sorted(r["item_id"] for r in picked.collect()) == sorted(order[: round(701 * fraction)])


def test_no_row_is_shuffled(spark):
    df = spark.range(1000).withColumnRenamed("id", "item_id")
    plan = sampling.sample_exact(df, "item_id", 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_empty(spark):
    assert sampling.sample_exact(spark.createDataFrame([], "item_id long"), "item_id", 0.5).count() == 0
