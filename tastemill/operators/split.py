"""Time split per user, recent items, mean-centring."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastemill.operators.quantile import group_quantile
from tastemill.operators.skew import lookup


def with_cut(ratings: DataFrame, q: float = 0.8) -> DataFrame:
    """Ratings with the ``q`` quantile of their user's rating times as ``cut``."""
    return lookup(ratings, group_quantile(ratings, "user_id", "ts", q), "user_id", ["item_id"])


def old_part(cut_ratings: DataFrame) -> DataFrame:
    return cut_ratings.where(F.col("ts") <= F.col("cut")).drop("cut")


def new_part(cut_ratings: DataFrame, semantics: str = "reference") -> DataFrame:
    """The later part. Rows exactly at the cut belong to both parts unless ``corrected``."""
    later = F.col("ts") > F.col("cut") if semantics == "corrected" else F.col("ts") >= F.col("cut")
    return cut_ratings.where(later).drop("cut")


def recent_items(old: DataFrame, time_limit: float = 0.2) -> DataFrame:
    """(user_id, item_id) of the latest ``time_limit`` share of each user's ratings."""
    return with_cut(old, 1 - time_limit).where(F.col("ts") > F.col("cut")).select("user_id", "item_id")


def user_means(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("user_id").agg(F.avg("rating").alias("user_mean"))


def centred(ratings: DataFrame) -> DataFrame:
    """Ratings with ``user_mean`` and ``centred`` = rating - user_mean (9 digits)."""
    return lookup(ratings, user_means(ratings), "user_id", ["item_id"]).withColumn(
        "centred", F.round(F.col("rating") - F.col("user_mean"), 9)
    )
