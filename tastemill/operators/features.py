"""Item feature vectors: tag vectors, imputation, unit length."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastemill.functions.vectors import unit
from tastemill.operators.skew import lookup
from tastemill.session import stage


def tag_vectors(scores: DataFrame) -> DataFrame:
    """Long (item_id, tag_id, relevance) rows to one ``tags`` array in tag order.

    An item has one score per tag, so an array is as long as the tag catalogue.
    """
    cells = F.array_sort(F.collect_list(F.struct("tag_id", "relevance")))
    return scores.groupBy("item_id").agg(F.transform(cells, lambda c: c["relevance"]).alias("tags"))


def _mean_vectors(vectors: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Element-wise mean per group: one average per (group, position), then one array."""
    means = (
        vectors.select(*keys, F.posexplode("tags").alias("_i", "_x"))
        .groupBy(*keys, "_i")
        .agg(F.avg("_x").alias("_x"))
    )
    cells = F.array_sort(F.collect_list(F.struct("_i", "_x")))
    return means.groupBy(*keys).agg(F.transform(cells, lambda c: c["_x"]).alias(name))


def impute(items: DataFrame, vectors: DataFrame, semantics: str = "reference") -> DataFrame:
    """Items with ``genre_vec`` and a ``tags`` array for every one of them.

    An item without tags gets the mean of the items with the same genres, and if those
    have no tags either the mean over all items. ``corrected`` tries one more group in
    between: the items that lack (at least) the same genres.
    """
    known = items.select("item_id", "genre_vec").join(vectors, "item_id", "left")
    have = known.where(F.col("tags").isNotNull())
    lack = stage(known.where(F.col("tags").isNull()).drop("tags"), "no-tags")
    overall = _mean_vectors(have, [], "tags")
    same = _mean_vectors(have, ["genre_vec"], "_same")
    filled = lookup(lack, same, "genre_vec", ["item_id"], "left")
    tiers = [F.col("_same")]
    if semantics == "corrected":
        wider = _wider_means(lack, have, same)
        filled = lookup(stage(filled, "same-genres"), wider, "genre_vec", ["item_id"], "left")
        tiers.append(F.col("_wider"))
    filled = filled.select("item_id", "genre_vec", F.coalesce(*tiers, overall.scalar()).alias("tags"))
    return have.select("item_id", "genre_vec", "tags").unionByName(filled)


def _wider_means(lack: DataFrame, have: DataFrame, same: DataFrame) -> DataFrame:
    """Mean over the items whose genres are a subset of a given genre set.

    Works on distinct genre sets: each set still without a mean is matched to the sets
    that share one of its genres (or are empty), weighted by their item counts.
    """
    genres = F.filter(
        F.transform("genre_vec", lambda g, i: F.when(g != 0, i)), lambda i: i.isNotNull()
    )
    weights = have.groupBy("genre_vec").agg(F.count(F.lit(1)).alias("_w"))
    donors = same.join(weights, "genre_vec").select(genres.alias("_sub"), "_w", F.col("_same").alias("tags"))
    open_sets = (
        lack.select("genre_vec").distinct().join(same, "genre_vec", "left_anti").select("genre_vec", genres.alias("_set"))
    )
    keyed_donors = donors.withColumn("_g", F.when(F.size("_sub") > 0, F.col("_sub")[0]).otherwise(F.lit(-1)))
    keyed_sets = open_sets.withColumn("_g", F.explode(F.array_append(F.col("_set"), F.lit(-1))))
    pairs = keyed_sets.join(keyed_donors, "_g").where(F.size(F.array_except("_sub", "_set")) == 0)
    means = (
        pairs.select("genre_vec", "_w", F.posexplode("tags").alias("_i", "_x"))
        .groupBy("genre_vec", "_i")
        .agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_x"))
    )
    cells = F.array_sort(F.collect_list(F.struct("_i", "_x")))
    return means.groupBy("genre_vec").agg(F.transform(cells, lambda c: c["_x"]).alias("_wider"))


def unit_vectors(imputed: DataFrame) -> DataFrame:
    """(item_id, vec): genres and tags in one vector of length 1."""
    return imputed.select("item_id", unit(F.concat("genre_vec", "tags")).alias("vec"))
