"""What the factor models share: completing, predicting and ranking."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tastemill.functions.vectors import dot, zeros
from tastemill.operators.cosine import pair_cosine
from tastemill.operators.dense_top import dense_candidates
from tastemill.operators.rank import settled, top_n
from tastemill.operators.skew import lookup
from tastemill.session import stage


@dataclass
class Factors:
    """``users`` (user_id, vec) and ``items`` (item_id, vec) with vectors of length ``k``.

    Ids that are missing have a zero vector. ``losses`` and ``history`` are per step.
    """

    users: DataFrame
    items: DataFrame
    k: int
    losses: list[float] = field(default_factory=list)
    history: list[tuple[DataFrame, DataFrame]] = field(default_factory=list)


def complete(factors: DataFrame, ids: DataFrame, key: str, k: int) -> DataFrame:
    filled = F.coalesce("vec", zeros(k)) if k else F.array(F.lit(0.0))
    return ids.select(key).distinct().join(factors.select(key, "vec"), key, "left").select(key, filled.alias("vec"))


def predict_cells(model: Factors, cells: DataFrame) -> DataFrame:
    """``cells`` with the predicted (centred) value as ``pred``."""
    of_user = model.users.select("user_id", F.col("vec").alias("_u"))
    of_item = model.items.select("item_id", F.col("vec").alias("_i"))
    half = stage(lookup(cells, of_user, "user_id", ["item_id"], "left"), "cells")
    both = lookup(half, of_item, "item_id", ["user_id"], "left")
    return both.withColumn("pred", F.coalesce(dot(F.col("_u"), F.col("_i")), F.lit(0.0))).drop("_u", "_i")


def recommend_factors(
    model: Factors,
    users: DataFrame,
    items: DataFrame,
    seen: DataFrame | None,
    n: int = 10,
    floor: float | None = 0.0,
) -> DataFrame:
    """Best unseen items per user with a predicted value of at least ``floor``."""
    rows, catalogue = complete(model.users, users, "user_id", model.k), complete(model.items, items, "item_id", model.k)
    return top_n(dense_candidates(rows, catalogue, "user_id", "item_id", n, max(model.k, 1), floor, seen), n)


def recommend_dissimilar(
    model: Factors,
    users: DataFrame,
    items: DataFrame,
    seen: DataFrame,
    vectors: DataFrame,
    n: int = 10,
    limit: float = 0.8,
) -> DataFrame:
    """As above, without items too similar to an item the user rated and is predicted to like.

    An item stays if its similarity to each such rated item is below ``limit``. Candidates
    are checked in rounds of growing length, so only users whose best candidates were
    dropped are looked at again.
    """
    liked = predict_cells(model, seen.select("user_id", "item_id")).where(settled(F.col("pred")) >= 0)
    liked = stage(liked.select("user_id", F.col("item_id").alias("j")), "liked")
    total, width = items.select("item_id").distinct().count(), 4 * n
    left, found = users.select("user_id").distinct(), None
    while True:
        ranked = stage(recommend_factors(model, left, items, seen, width), "ranked")
        met = lookup(liked, ranked.select("user_id", F.col("item_id").alias("i")), "user_id", ["j"])
        met = stage(met, "met-pairs")
        close = pair_cosine(met.select("i", "j").distinct(), vectors).where(F.col("sim") >= limit).select("i", "j")
        dropped = lookup(met, close, ["i", "j"], ["user_id"]).select("user_id", F.col("i").alias("item_id")).distinct()
        best = stage(top_n(ranked.join(dropped, ["user_id", "item_id"], "left_anti").drop("rank"), n), "dissimilar")
        if width >= total:
            return best if found is None else found.unionByName(best)
        got = best.groupBy("user_id").agg(F.count(F.lit(1)).alias("got"))
        seen_all = ranked.groupBy("user_id").agg(F.count(F.lit(1)).alias("all"))
        done = (
            left.join(got, "user_id", "left")
            .join(seen_all, "user_id", "left")
            .where((F.coalesce("got", F.lit(0)) == n) | (F.coalesce("all", F.lit(0)) < width))
            .select("user_id")
        )
        full = best.join(done, "user_id", "left_semi")
        found = full if found is None else found.unionByName(full)
        left = stage(left.join(done, "user_id", "left_anti"), "short-users")
        if left.isEmpty():
            return found
        width *= 4
