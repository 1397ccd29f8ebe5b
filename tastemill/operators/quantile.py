"""Exact interpolated quantile per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tastemill.operators.skew import hot_keys, sizes_of


def group_quantile(
    rows: DataFrame,
    key: str,
    value: str,
    q: float,
    cell: int = 86400,
    split_rows: int | None = None,
) -> DataFrame:
    """``(key, cut)``: linear-interpolation quantile of an integer column per group.

    Ordinary groups use the built-in exact percentile. Groups above ``split_rows`` would
    need all their values in one task, so they are resolved in two steps: counts per cell
    of the value range find the one or two cells that hold the wanted ranks, and only the
    distinct values of those cells (at most ``cell`` of them) are ranked.
    """
    values = rows.where(F.col(value).isNotNull()).select(key, value)
    hot = hot_keys(values, key, split_rows)
    if hot is None:
        return _built_in(values, key, value, q)
    heavy = sizes_of(values.join(F.broadcast(hot.select(key)), key, "left_semi"), key)
    light = _built_in(values.join(F.broadcast(hot.select(key)), key, "left_anti"), key, value, q)

    position = F.lit(q) * (F.col("n") - 1)
    wanted = heavy.select(
        key,
        position.alias("_pos"),
        F.floor(position).alias("_lo"),
        F.ceil(position).alias("_hi"),
    )
    points = (
        values.join(F.broadcast(wanted.select(key)), key)
        .groupBy(key, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_cell", F.floor(F.col("_v") / cell))
    )
    by_cell = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = (
        points.groupBy(key, "_cell")
        .agg(F.sum("_c").alias("_c"))
        .withColumn("_upto", F.sum("_c").over(by_cell))
        .withColumn("_before", F.col("_upto") - F.col("_c"))
        .join(F.broadcast(wanted), key)
        .where(
            F.col("_lo").between(F.col("_before"), F.col("_upto") - 1)
            | F.col("_hi").between(F.col("_before"), F.col("_upto") - 1)
        )
        .select(key, "_cell", "_pos", "_lo", "_hi", "_before")
    )
    by_value = (
        Window.partitionBy(key, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = (
        points.join(F.broadcast(cells), [key, "_cell"])
        .withColumn("_end", F.col("_before") + F.sum("_c").over(by_value))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )
    low = F.max(F.when(F.col("_lo").between(F.col("_start"), F.col("_end") - 1), F.col("_v")))
    high = F.max(F.when(F.col("_hi").between(F.col("_start"), F.col("_end") - 1), F.col("_v")))
    solved = (
        ranked.groupBy(key, "_pos", "_lo", "_hi")
        .agg(low.alias("_a"), high.alias("_b"))
        .select(
            key,
            F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("double"))
            .otherwise((F.col("_hi") - F.col("_pos")) * F.col("_a") + (F.col("_pos") - F.col("_lo")) * F.col("_b"))
            .alias("cut"),
        )
    )
    return light.unionByName(solved)


def _built_in(values: DataFrame, key: str, value: str, q: float) -> DataFrame:
    return values.groupBy(key).agg(F.percentile(value, F.lit(q)).alias("cut"))
