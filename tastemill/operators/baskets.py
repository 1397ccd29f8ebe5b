"""Baskets: groups of items a user rated close together in time.

Baskets are long rows ``(user_id, basket_no, item_id, basket_size)``; only baskets with
more than one item are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tastemill.operators.skew import lookup
from tastemill.schema import SECONDS_PER_DAY

# Item ids of a long basket that are put in order together.
CELL_ITEMS = 65_536


def gap_baskets(ratings: DataFrame, gap_days: float = 25.0) -> DataFrame:
    """A new basket starts where a user pauses for more than ``gap_days``.

    Two times in one cell of ``gap`` seconds are never more than a gap apart, so breaks
    can only lie between cells. The rows are reduced to (user, cell) bounds first and
    the ordered pass per user sees at most time span / gap rows.
    """
    gap = int(gap_days * SECONDS_PER_DAY)
    cell = F.floor(F.col("ts") / gap)
    bounds = (
        ratings.groupBy("user_id", cell.alias("_cell"))
        .agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.count(F.lit(1)).alias("n"))
    )
    by_time = Window.partitionBy("user_id").orderBy("_cell")
    breaks = (F.col("_first") - F.lag("_last").over(by_time) > gap).cast("int")
    numbered = bounds.withColumn("_break", F.coalesce(breaks, F.lit(1))).withColumn(
        "basket_no", F.sum("_break").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    whole = Window.partitionBy("user_id", "basket_no")
    sized = numbered.withColumn("basket_size", F.sum("n").over(whole)).where(F.col("basket_size") > 1)
    return lookup(
        ratings.select("user_id", "item_id", cell.alias("_cell")),
        sized.select("user_id", "_cell", "basket_no", "basket_size"),
        ["user_id", "_cell"],
        ["item_id"],
    ).select("user_id", "basket_no", "item_id", "basket_size")


def with_size(members: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``basket_size`` to basket rows and keep baskets of more than one item."""
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("basket_size")).where(F.col("basket_size") > 1)
    return lookup(members, sizes, keys, ["item_id"])


def basket_lists(baskets: DataFrame, keys: list[str], length: int = 1000, overlap: int = 0) -> DataFrame:
    """(keys, piece, items): baskets as item lists in catalogue order.

    Piece p holds the places p * length to (p + 1) * length of the basket, and the
    ``overlap`` places after them, so no list grows with a basket. The places of a long
    basket come from counts per cell of item ids and the order inside a cell, so that it
    is never sorted in one task.
    """
    short = baskets.where(F.col("basket_size") <= length).select(*keys, "item_id", F.lit(0).cast("long").alias("piece"))
    long = baskets.where(F.col("basket_size") > length).select(*keys, "item_id", F.floor(F.col("item_id") / CELL_ITEMS).alias("_cell"))
    cells = long.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy("item_id"))
    placed = long.join(cells, [*keys, "_cell"]).withColumn("_place", F.col("_first") + inside - 1)
    own = F.floor(F.col("_place") / length)
    pieces = F.when((F.col("_place") % length < overlap) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    long = placed.select(*keys, "item_id", F.explode(pieces).alias("piece"))
    return short.unionByName(long).groupBy(*keys, "piece").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
