"""The same list of the most popular items for everyone (control group)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastemill.operators.rank import first_free, top_n


def hot_items(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, score): sum of ratings; items never rated score 0."""
    sums = ratings.groupBy("item_id").agg(F.sum("rating").alias("score"))
    return items.select("item_id").join(sums, "item_id", "left").select("item_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def recommend_hot(hot: DataFrame, users: DataFrame, n: int = 10, seen: DataFrame | None = None) -> DataFrame:
    """The ``n`` most popular items for every user; with ``seen``, of those not yet rated.

    The common list is one scalar subquery of ``n`` entries that each user row unfolds.
    """
    if seen is not None:
        return top_n(first_free(hot, seen.select("user_id", "item_id"), users, n), n)
    best = hot.orderBy(F.desc("score"), F.asc("item_id")).limit(n)
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "item_id"))).alias("best"))
    return users.select("user_id", F.posexplode(listed.scalar()).alias("at", "e")).select(
        "user_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("e.item_id").alias("item_id"),
        (-F.col("e.s")).alias("score"),
    )
