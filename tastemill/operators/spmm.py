"""Sparse matrix times a tall block of vectors, the core of the factor models and walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastemill.functions.vectors import sums_by
from tastemill.operators.skew import hot_keys, replicate, salt_rows
from tastemill.session import stage


class SparseMatrix:
    """Entries (row, col, value) staged once, ready for products in both directions.

    Rows and columns with very many entries are salted when the matrix is built; a
    product then copies the vector of a heavy key to each of its parts and leaves all
    other keys alone. Partial sums are formed before the shuffle.
    """

    def __init__(self, entries: DataFrame, row: str, col: str, value: str, split_rows: int | None = None):
        self.row, self.col = row, col
        cells = entries.select(row, col, F.col(value).cast("double").alias("_value"))
        cells = stage(cells, "matrix")
        self.hot = {key: hot_keys(cells, key, split_rows) for key in (row, col)}
        if any(hot is not None for hot in self.hot.values()):
            for key, other in ((row, col), (col, row)):
                cells = salt_rows(cells, self.hot[key], key, [other], f"_salt_{key}")
            cells = stage(cells, "matrix")
        self.cells = cells

    def _product(self, block: DataFrame, key: str, out: str, k: int, extra: list[str]) -> DataFrame:
        vectors, on = block.select(*extra, key, "vec"), [key]
        if self.hot[key] is not None:
            on.append(f"_salt_{key}")
            vectors = replicate(vectors, self.hot[key], key, on[1])
        return sums_by(self.cells.select(out, *on, "_value").join(vectors, on), [*extra, out], "vec", k, "_value")

    def times(self, block: DataFrame, k: int, extra: list[str] | None = None) -> DataFrame:
        """(row, vec) = matrix x (col, vec)."""
        return self._product(block, self.col, self.row, k, extra or [])

    def transposed_times(self, block: DataFrame, k: int, extra: list[str] | None = None) -> DataFrame:
        """(col, vec) = transposed matrix x (row, vec)."""
        return self._product(block, self.row, self.col, k, extra or [])
