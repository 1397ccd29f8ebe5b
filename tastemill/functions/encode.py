"""Column functions: encodings, scaling, time."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tastemill.schema import SECONDS_PER_DAY


def multi_hot(joined: Column, vocabulary: Iterable[str], sep: str = "|") -> list[Column]:
    """One 0/1 column per vocabulary entry that occurs in a ``sep``-joined string."""
    tokens = F.split(joined, f"[{sep}]")
    return [F.array_contains(tokens, word).cast("int").alias(word) for word in vocabulary]


def multi_hot_array(joined: Column, vocabulary: Iterable[str], sep: str = "|") -> Column:
    """The same flags as one ``array<double>``."""
    tokens = F.split(joined, f"[{sep}]")
    flags = [F.array_contains(tokens, word).cast("double") for word in vocabulary]
    return F.coalesce(F.array(*flags), F.array(*[F.lit(0.0)] * len(flags)))


def category_code(value: Column, codes: Mapping[str, int]) -> Column:
    """Map category names to numbers; names that are not listed become NULL."""
    pairs = [F.lit(part) for item in codes.items() for part in item]
    return F.create_map(*pairs)[value]


def min_max(value: Column, low: Column, high: Column, positive: bool = True) -> Column:
    """Scale to 0..1; a constant column becomes 1."""
    scaled = (value - low) if positive else (high - value)
    return F.when(low == high, F.lit(1.0)).otherwise(scaled / (high - low))


def with_min_max(df: DataFrame, columns: Iterable[str], positive: bool = True) -> DataFrame:
    """Min-max scale columns of a table in place.

    The bounds come from one aggregate that is read back as a scalar subquery, so the
    table itself is not shuffled.
    """
    columns = list(columns)
    bounds = df.agg(
        F.struct(
            *[F.min(c).alias(f"{c}_low") for c in columns],
            *[F.max(c).alias(f"{c}_high") for c in columns],
        ).alias("bounds")
    )
    scaled = {
        c: min_max(F.col(c), F.col("_bounds")[f"{c}_low"], F.col("_bounds")[f"{c}_high"], positive)
        for c in columns
    }
    return df.withColumn("_bounds", bounds.scalar()).withColumns(scaled).drop("_bounds")


def days(ts: Column) -> Column:
    return ts / F.lit(SECONDS_PER_DAY)


def epoch_seconds(stamp: str) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp column, in any session zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', `{stamp}`)")


def label(prefix: str, key: Column) -> Column:
    """Vertex label such as ``U_17``."""
    return F.concat(F.lit(f"{prefix}_"), key.cast("string"))


def unlabel(vertex: Column) -> Column:
    return F.substring(vertex, 3, 20).cast("long")


def hex_number(text: Column, digits: int = 15) -> Column:
    """The first hex digits of the md5 of a text, as a whole number."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")
