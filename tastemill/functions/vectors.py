"""Arithmetic on ``array<double>`` columns and k x k helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """Scale to length 1; a zero vector stays zero."""
    length = F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x, lambda s: F.sqrt(s))
    return F.transform(
        F.arrays_zip(a.alias("x"), F.array_repeat(length, F.size(a)).alias("l")),
        lambda e: F.when(e["l"] > 0, e["x"] / e["l"]).otherwise(0.0),
    )


def zeros(k: int) -> Column:
    return F.array_repeat(F.lit(0.0), k)


def sum_vectors(vec: str, k: int, scale: str = "1.0D") -> Column:
    """Aggregate: element-wise sum of ``scale * vec``, one partial sum per element."""
    return F.expr("array(" + ", ".join(f"sum({scale} * {vec}[{i}])" for i in range(k)) + ")")


# Elements that one aggregation sums; wider vectors are summed in chunks of this length.
CHUNK = 32


def sums_by(rows: DataFrame, keys: list[str], vec: str, k: int, scale: str = "1.0D") -> DataFrame:
    """(keys, vec): element-wise sum of ``scale * vec`` per group.

    A wide vector is cut into chunks that are summed by (keys, chunk), which keeps the
    generated code of the aggregation small.
    """
    if k <= 2 * CHUNK:
        return rows.groupBy(*keys).agg(sum_vectors(vec, k, scale).alias("vec"))
    count = -(-k // CHUNK)
    padded = F.concat(F.col(vec), zeros(count * CHUNK - k))
    cut = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda c: F.struct(c.alias("_c"), F.slice(padded, c * CHUNK + 1, CHUNK).alias("_part")))
    parts = rows.select(*keys, F.expr(scale).alias("_scale"), F.inline(cut)).groupBy(*keys, "_c")
    parts = parts.agg(sum_vectors("_part", CHUNK, "_scale").alias("_part"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_part"))), lambda p: p["_part"]))
    return parts.groupBy(*keys).agg(F.slice(whole, 1, k).alias("vec"))


def stack(vectors: pd.Series, k: int) -> np.ndarray:
    return np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, k))


def times_matrix(df: DataFrame, vec: str, matrix: np.ndarray) -> DataFrame:
    """Multiply each row vector (length k) by a matrix with k rows."""
    k = matrix.shape[0]

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[vec] = list(stack(batch[vec], k) @ matrix)
            yield batch

    return df.mapInPandas(multiply, df.schema)


def gram(df: DataFrame, vec: str, k: int) -> np.ndarray:
    """Sum of the outer products of the row vectors; only k x k numbers are collected."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for batch in batches:
            block = stack(batch[vec], k)
            total += block.T @ block
        yield pd.DataFrame({"cell": np.arange(k * k), "value": total.ravel()})

    cells = (
        df.select(vec)
        .mapInPandas(partial, "cell int, value double")
        .groupBy("cell")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    out = np.zeros(k * k)
    for cell in cells:
        out[cell["cell"]] = cell["value"]
    return out.reshape(k, k)
