"""Samples and restrictions of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastemill.operators.skew import lookup
from tastemill.session import stage


# Hash digits counted at a time (16 ** 3 cells), and keys that one cell may have to be sorted.
DIGITS, FEW_KEYS = 3, 100_000


def sample_exact(df: DataFrame, key: str, fraction: float, seed: str = "") -> DataFrame:
    """Exactly round(fraction * n) rows of a catalogue (keys do not repeat), picked by hash order.

    Counts per hash cell, refined inside the cell that holds the last picked key, tell that key; the
    sample is then a filter, and no row of the catalogue is shuffled. Null keys are not picked.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    keyed = df.select(F.col(key).alias("_key"), digest.alias("_h")).where("_h IS NOT NULL")
    left = round(df.count() * fraction)
    if left <= 0:
        return df.where(F.lit(False))
    prefix, many = "", FEW_KEYS + 1
    while many > FEW_KEYS and len(prefix) < 32:
        cells = keyed.where(F.col("_h").startswith(prefix)).groupBy(F.substring("_h", len(prefix) + 1, DIGITS).alias("_cell")).count()
        for cell, many in sorted(tuple(r) for r in cells.collect()):  # at most 16 ** DIGITS
            if left <= many:
                prefix += cell
                break
            left -= many
        else:
            return df.where(digest.isNotNull())
    first = keyed.where(F.col("_h").startswith(prefix)).orderBy("_h", "_key").limit(left)
    last = first.agg(F.max(F.struct("_h", "_key"))).first()[0]
    return df.where((digest < last["_h"]) | ((digest == last["_h"]) & (F.col(key) <= last["_key"])))


def restrict(ratings: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """Ratings of the given users on the given items."""
    of_items = stage(lookup(ratings, items.select("item_id"), "item_id", ["user_id"], "left_semi"), "of-items")
    return lookup(of_items, users.select("user_id"), "user_id", ["item_id"], "left_semi")


def up_to_last_item(scores: DataFrame, items: DataFrame, semantics: str = "reference") -> DataFrame:
    """Tag scores of ids up to the largest item id; ``corrected`` keeps known items only."""
    if semantics == "corrected":
        return scores.join(items.select("item_id"), "item_id", "left_semi")
    last = items.agg(F.max("item_id").alias("last"))
    return scores.where(F.col("item_id") <= last.scalar())
