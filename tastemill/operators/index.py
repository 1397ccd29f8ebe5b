"""Dense positions 0..n-1 without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Hex digits of the hash that pick the cell: 16**3 = 4096 cells.
CELL_DIGITS = 3


def dense_index(df: DataFrame, key: str, seed: str = "", name: str = "pos") -> DataFrame:
    """``(key, name)``: position of each distinct key in the order of md5(key + seed).

    Keys are numbered inside 4096 hash cells in parallel; the starts of the cells come
    from a running sum over at most 4096 counts.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    keys = df.select(key).distinct().withColumn("_h", digest)
    keys = keys.withColumn("_cell", F.substring("_h", 1, CELL_DIGITS))
    inside = Window.partitionBy("_cell").orderBy("_h", key)
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keys.groupBy("_cell")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select("_cell", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    )
    return (
        keys.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(starts), "_cell")
        .select(key, (F.col("_start") + F.col("_rn") - 1).cast("long").alias(name))
    )
