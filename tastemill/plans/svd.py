"""Truncated singular value decomposition of the zero-filled centred ratings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tastemill.functions.vectors import gram, times_matrix
from tastemill.operators.index import dense_index
from tastemill.operators.spmm import SparseMatrix
from tastemill.plans.als import hashed_start
from tastemill.plans.factors import Factors
from tastemill.session import stage, unstage

# Components that are computed at first; twice as many if they do not reach the energy.
FIRST_K = 64
# Up to this many columns the basis is the identity and one product gives all components.
WHOLE_COLUMNS = 256
# Rounds of the iteration, and the relative change of the singular values that ends it.
ROUNDS, REST = 200, 1e-10


def keep_count(sigma: np.ndarray, total: float, energy_ratio: float, semantics: str = "reference") -> int | None:
    """Components to keep, or None if the known ones do not reach the energy yet.

    The reference keeps one component fewer than the energy needs.
    """
    reached = np.flatnonzero(np.cumsum(sigma**2) / total >= energy_ratio - 1e-12)
    if not len(reached):
        return None
    return int(reached[0]) + (1 if semantics == "corrected" else 0)


def svd(
    ratings: DataFrame,
    users: DataFrame,
    items: DataFrame,
    energy_ratio: float = 0.8,
    value: str = "centred",
    semantics: str = "reference",
    first_k: int = FIRST_K,
    whole_columns: int = WHOLE_COLUMNS,
) -> tuple[Factors, np.ndarray]:
    """Factors of the rank-k approximation, and the singular values that were computed.

    The total energy is the sum of the squared ratings, so only as many components as
    are needed are computed: their number doubles until the energy is reached (a ratio
    above 1 keeps all). The components come from block subspace iteration over the
    smaller catalogue: vectors stay in tables, the driver sees m x m matrices only.
    Their number also doubles if more are to be kept than have settled; once it takes
    all columns the basis is the identity, which is exact.
    """
    n_users, n_items = users.select("user_id").distinct().count(), items.select("item_id").distinct().count()
    by_item = n_items <= n_users
    col, row, columns = ("item_id", "user_id", n_items) if by_item else ("user_id", "item_id", n_users)
    total = ratings.agg(F.sum(F.col(value) * F.col(value))).first()[0] or 0.0
    if total == 0:
        nothing = F.array().cast("array<double>").alias("vec")
        return Factors(users.select("user_id", nothing), items.select("item_id", nothing), 0), np.zeros(0)
    matrix = SparseMatrix(ratings, row, col, value)
    ids = stage(dense_index(items if by_item else users, col), "svd-columns")
    m = columns if columns <= whole_columns else min(columns, first_k)
    basis = stage(_start(ids, col, m, columns), "svd-basis")
    while True:
        basis, sigma, turn, settled = _subspace(matrix, basis, row, col, m, m == columns)
        keep = keep_count(sigma, total, energy_ratio, semantics)
        if m == columns or keep is not None and keep < settled:
            break
        wider = min(columns, 2 * m)
        if wider == columns:
            wide = _start(ids, col, wider, columns)
        else:
            more = hashed_start("svd")(col, wider - m)
            wide = basis.select(col, F.concat("vec", F.transform(more, lambda x: x - 0.5)).alias("vec"))
        basis, m = stage(wide, "svd-basis"), wider
    sigma = sigma[:settled]
    k = len(sigma) if keep is None else keep
    col_factors = stage(times_matrix(basis, "vec", turn[:, :k]), "svd-basis")
    if k == 0:
        row_factors = ratings.select(row).distinct().withColumn("vec", F.array().cast("array<double>"))
    else:
        row_factors = stage(matrix.times(col_factors, k), "svd-rows")
    pair = (row_factors, col_factors) if by_item else (col_factors, row_factors)
    return Factors(pair[0], pair[1], k), sigma


def _start(ids: DataFrame, col: str, m: int, columns: int) -> DataFrame:
    """The identity if it is small enough, else hashed numbers around 0."""
    if m == columns:
        vec = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda i: F.when(i == F.col("pos"), 1.0).otherwise(0.0))
    else:
        vec = F.transform(hashed_start("svd")(col, m), lambda x: x - 0.5)
    return ids.select(col, vec.alias("vec"))


def _subspace(matrix: SparseMatrix, basis: DataFrame, row: str, col: str, m: int, whole: bool) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    """Orthonormal basis, singular values on it, the turn that sorts them and how many have settled.

    Each round multiplies the basis by A'A and makes it orthonormal again, in one sparse
    product each way; the values come from the m x m matrix of the products.
    """
    before, settled = np.zeros(m), m
    for _ in range(1 if whole else ROUNDS):
        if not whole:
            basis = _orthonormal(basis, m)
        image = stage(matrix.times(basis, m), "svd-image")
        values, turn = np.linalg.eigh(gram(image, "vec", m))
        sigma, turn = np.sqrt(np.maximum(values[::-1], 0)), turn[:, ::-1]
        if whole:
            break
        moved = np.abs(sigma - before) > REST * sigma[0]
        settled = int(np.argmax(moved)) if moved.any() else m
        if settled >= max(1, m // 2):
            break
        before = sigma
        basis = stage(matrix.transposed_times(image, m), "svd-basis")
        unstage(image)
    return basis, sigma, turn, settled


def _orthonormal(basis: DataFrame, m: int) -> DataFrame:
    """Twice over, as one pass loses digits when the vectors are nearly dependent."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(gram(basis, "vec", m))
        scale = 1 / np.sqrt(np.maximum(values, values[-1] * 1e-14))
        basis = stage(times_matrix(basis, "vec", vectors * scale), "svd-basis")
    return basis


def energy(sigma: np.ndarray, total: float) -> list[float]:
    return list(np.cumsum(np.asarray(sigma) ** 2) / total)
