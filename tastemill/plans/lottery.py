"""Random lists without replacement (control group), reproducible by seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tastemill.functions.encode import hex_number
from tastemill.operators.index import dense_index


def recommend_random(items: DataFrame, users: DataFrame, n: int = 10, seed: str = "0") -> DataFrame:
    """``n`` distinct random items per user.

    Each user draws n positions of the item index by sampling without replacement: step
    j of the last n positions takes a random position up to j, or j itself if that one is
    taken. Nothing of size users x items is formed.
    """
    total = items.agg(F.countDistinct("item_id").alias("total"))
    drawn = F.aggregate(
        F.sequence(F.greatest(F.col("_total") - n, F.lit(0)), F.col("_total") - 1),
        F.array().cast("array<bigint>"),
        lambda taken, j: F.array_append(taken, _pick(taken, j, seed)),
    )
    draws = (
        users.select("user_id")
        .withColumn("_total", total.scalar())
        .where(F.col("_total") > 0)
        .select("user_id", F.posexplode(drawn).alias("at", "pos"))
    )
    return draws.join(dense_index(items, "item_id"), "pos").select(
        "user_id", (F.col("at") + 1).cast("int").alias("rank"), "item_id", F.lit(0.0).alias("score")
    )


def _pick(taken: Column, j: Column, seed: str) -> Column:
    text = F.concat_ws("-", F.col("user_id").cast("string"), j.cast("string"), F.lit(seed))
    draw = F.pmod(hex_number(text), j + 1)
    return F.when(F.array_contains(taken, draw), j).otherwise(draw)
