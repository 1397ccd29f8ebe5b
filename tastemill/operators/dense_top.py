"""Best matches of many row vectors in a catalogue of vectors."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tastemill.operators.rank import NOISE
from tastemill.session import stage

# Vectors of a block, and cells that are scored at a time.
BLOCK_BYTES = 16 * 2**20
SCORE_CELLS = 4_000_000
# Rows that make a block of their own worthwhile.
LEAST_ROWS = 64


def best_positions(scores: np.ndarray, want: int) -> np.ndarray:
    """Positions of the ``want`` largest scores; ties go to the smaller position."""
    n = len(scores)
    if want >= n:
        return np.flatnonzero(scores > -np.inf)
    edge = np.partition(scores, n - want)[n - want]
    above = np.flatnonzero(scores > edge)
    if edge == -np.inf:
        return above
    ties = np.flatnonzero(scores == edge)[: want - len(above)]
    return np.concatenate([above, ties])


def dense_candidates(
    rows: DataFrame,
    catalogue: DataFrame,
    row: str,
    item: str,
    n: int,
    k: int,
    floor: float | None = None,
    seen: DataFrame | None = None,
    block_bytes: int = BLOCK_BYTES,
    mass: bool = False,
) -> DataFrame:
    """(row, item, score): for each row its ``n`` best items of each block of the catalogue.

    With ``mass`` there is a fourth column: on the first of these rows the logarithm of the sum of
    exp(score) over the whole block, else null. It does not go with ``floor`` or ``seen``.

    ``rows`` has (row, vec), ``catalogue`` (item, vec), ``seen`` (row, item) pairs that are
    left out. Rows and items are hashed into blocks of at most ``block_bytes``; each pair of
    blocks is one group and scored in one task as a small dense product, with the seen
    items masked there. Nothing passes through the driver, and what leaves is at most
    ``n`` rows per row and block.
    """
    if mass and (floor is not None or seen is not None):
        raise ValueError("the mass of a block is that of all its items")
    rows, catalogue = stage(rows.select(row, "vec"), "score-rows"), stage(catalogue.select(item, "vec"), "score-items")
    blocks = lambda count: max(1, ceil(count * (k + 1) * 8 / block_bytes))
    lines = rows.count()
    # more blocks than memory asks for keep all cores busy while rows are few
    row_blocks = max(blocks(lines), min(rows.sparkSession.sparkContext.defaultParallelism, ceil(lines / LEAST_ROWS)))
    item_blocks = blocks(catalogue.count())
    place = lambda column, count: F.pmod(F.xxhash64(column), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.withColumn("_r", place(row, max(1, row_blocks))).withColumn("_i", every(item_blocks))
    if seen is None:
        left = left.withColumn("_seen", F.lit(None).cast("array<long>"))
    else:
        # pairs with an item that the catalogue has not would be sent for nothing
        known = seen.select(row, item).join(catalogue.select(item), item, "left_semi")
        masks = known.select(row, item, place(item, item_blocks).alias("_i")).groupBy(row, "_i")
        left = left.join(masks.agg(F.collect_set(item).alias("_seen")), [row, "_i"], "left")
    right = catalogue.withColumn("_i", place(item, item_blocks)).withColumn("_r", every(max(1, row_blocks)))
    both = left.groupBy("_r", "_i").cogroup(right.groupBy("_r", "_i"))
    shape = f"{row} long, {item} long, score double" + (", mass double" if mass else "")
    return both.applyInArrow(_score(row, item, n, k, floor, mass), shape)


def _matrix(table: pa.Table, k: int) -> np.ndarray:
    return table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, k)


def _score(row: str, item: str, n: int, k: int, floor: float | None, mass: bool = False):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column(item).to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        lines, found, values, masses = [], [], [], []
        if len(ids) and left.num_rows:
            matrix, vectors = _matrix(right, k)[order], _matrix(left, k)
            masks = left.column("_seen").to_pylist()
            step = max(1, SCORE_CELLS // len(ids))
            for start in range(0, len(vectors), step):
                raw = vectors[start : start + step] @ matrix.T
                cells = raw.astype(np.float32)
                peak = raw.max(axis=1)
                sums = peak + np.log(np.exp(raw - peak[:, None]).sum(axis=1)) if mass else peak
                if floor is not None:
                    cells[raw < floor - NOISE] = -np.inf
                for at, (cell, mask) in enumerate(zip(cells, masks[start : start + step])):
                    if mask:
                        where = np.searchsorted(ids, mask)
                        where = where[np.minimum(where, len(ids) - 1) == where]
                        cell[where[np.isin(ids[where], mask)]] = -np.inf
                    best = best_positions(cell, n)
                    lines.append(np.full(len(best), start + at))
                    found.append(best)
                    values.append(raw[at, best])
                    masses.append(np.where(np.arange(len(best)) == 0, sums[at], np.nan))
        lines, found = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (lines, found))
        values = np.concatenate(values) if values else np.zeros(0)
        out = {row: left.column(row).to_numpy()[lines].astype(np.int64), item: ids[found].astype(np.int64), "score": values + 0.0}
        if mass:
            out["mass"] = pa.array(np.concatenate(masses) if masses else np.zeros(0), from_pandas=True)
        return pa.table(out)

    return score
