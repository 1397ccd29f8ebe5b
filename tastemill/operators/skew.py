"""Joins that stay even when one key holds a large share of the rows.

The checks here run a small job when a query is put together: a row count, which Parquet
answers from its footers, and only for tables large enough to hold a hot key a count per
key with map-side partial counts. Callers pass staged tables, so nothing is computed
twice, and tables without a hot key keep the plain join the planner handles best.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, functions as F

from tastemill.session import stage

# A key with more rows than this is spread over several tasks.
SPLIT_ROWS = 2_000_000
# Narrow rows pack to a byte each or less, so tasks cut by the size of files would get millions of them.
DEAL_ROWS = 250_000


def as_list(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def sizes_of(rows: DataFrame, key: str | list[str]) -> DataFrame:
    return rows.groupBy(*as_list(key)).agg(F.count(F.lit(1)).alias("n"))


def hot_keys(rows: DataFrame, key: str | list[str], split_rows: int | None = None) -> DataFrame | None:
    """Keys above ``split_rows`` with the number of parts (``_parts``) to cut them into.

    None if there are none. At most total_rows / split_rows keys can qualify (half a
    million for 10**12 rows), which is what makes this table safe to broadcast.
    """
    split_rows = split_rows or SPLIT_ROWS
    if rows.count() <= split_rows:
        return None
    hot = sizes_of(rows, key).where(F.col("n") > split_rows)
    hot = stage(hot.select(*as_list(key), F.ceil(F.col("n") / split_rows).cast("int").alias("_parts")), "hot-keys")
    return None if hot.isEmpty() else hot


def deal(rows: DataFrame, key: str | list[str]) -> DataFrame:
    """Staged rows over as many tasks as there are cores, or more: about ``DEAL_ROWS`` a task.

    For narrow rows that the next step unfolds. The rows of a key stay together.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, ceil(rows.count() / DEAL_ROWS))
    return rows.repartition(tasks, *as_list(key))


def salt_rows(
    rows: DataFrame, hot: DataFrame | None, key: str | list[str], spread_on: list[str], salt: str = "_salt"
) -> DataFrame:
    """Give the rows of hot keys a part number; all other rows get part 0."""
    if hot is None:
        return rows.withColumn(salt, F.lit(0))
    part = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(*spread_on), F.col("_parts")).cast("int")
    )
    return rows.join(F.broadcast(hot), as_list(key), "left").withColumn(salt, part).drop("_parts")


def replicate(table: DataFrame, hot: DataFrame | None, key: str | list[str], salt: str = "_salt") -> DataFrame:
    """Copy the rows of a hot key once for each of its parts."""
    if hot is None:
        return table.withColumn(salt, F.lit(0))
    parts = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    return table.join(F.broadcast(hot), as_list(key), "left").withColumn(salt, F.explode(parts)).drop("_parts")


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str | list[str],
    spread_on: list[str],
    how: str = "inner",
    split_rows: int | None = None,
) -> DataFrame:
    """Join many rows to a table on a key some of the rows may share very often."""
    keys = as_list(key)
    hot = hot_keys(rows, keys, split_rows)
    if hot is None:
        return rows.join(table, keys, how)
    left = salt_rows(rows, hot, keys, spread_on)
    return left.join(replicate(table, hot, keys), keys + ["_salt"], how).drop("_salt")
