"""Operator 12: hard-negative mining by a vertical scan over columnar dimensions (BOND).

Rows are dealt into blocks that hold each dimension as a column. An anchor reads the dimensions in
descending order of its own magnitudes. After every few of them, each candidate's score lies between
its sum so far plus the least, and plus the most, that the remaining dimensions can add in this
block; candidates that these bounds rule out leave the bitmap. What is left at the end has exact
scores. The first scan finds the best rows of an anchor's label; their scores set the windows of the
second, in which the best rows of other labels are the hard negatives.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tastemill.session import stage

#: Rows of a block, anchors of a group that scans it together, dimensions between two looks at the bounds.
BLOCK, GROUP, STEP = 4096, 512, 8
#: Tasks of a scan at most; a task takes several pairs of block and group beyond that.
TASKS = 20_000


class Task(NamedTuple):
    """``positives`` best rows of the anchor's label; for each, the ``negatives`` best rows of other
    labels with a score from ``least`` to ``most`` times the positive's."""

    positives: int = 5
    negatives: int = 3
    least: Fraction = Fraction(50, 100)
    most: Fraction = Fraction(95, 100)

    def window(self, score: int) -> tuple[int, int]:
        """Integer scores from the first to the second are inside (none if they cross)."""
        low, high = self.least * score, self.most * score
        return -(-low.numerator // low.denominator), high.numerator // high.denominator


# -- the scan of one block -----------------------------------------------------------------------------


class Block:
    """Rows by label, one column of the matrix for each; ``columns[j]`` is dimension j."""

    def __init__(self, vectors: pa.ListArray, labels: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(labels, kind="stable")
        self.labels, self.ids, self.rows = labels[order], ids[order], rows[order]
        self.columns = np.ascontiguousarray(matrix(vectors)[order].T)
        self.bounds: dict = {}

    def span(self, label: int) -> tuple[int, int]:
        """Rows of this label."""
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def limits(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest value of each dimension in these rows."""
        if (a, b) not in self.bounds:
            part = self.columns[:, a:b]
            self.bounds[a, b] = (part.min(axis=1), part.max(axis=1))
        return self.bounds[a, b]


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of integers; shorter vectors are padded with 0."""
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out


def suited(columns: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both of one width, in the narrowest type in which all sums are exact whole numbers."""
    width = min(len(columns), anchors.shape[1])
    columns, anchors = columns[:width], anchors[:, :width]
    size = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    bound = 2 * width * size(columns) * size(anchors)
    if bound >= 1 << 62:
        raise ValueError("scores beyond 64 bits")
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return columns.astype(kind), anchors.astype(kind)


def scan(columns: np.ndarray, limits: tuple, anchor: np.ndarray, alive: np.ndarray, ranges: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that the bounds never ruled out, and their exact scores.

    A score lies between its sum so far plus ``least`` and plus ``most``, which are the same for all
    candidates; so ``ranges(sums, least, most)`` says which sums stay, as disjoint ranges.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor * limits[0], anchor * limits[1]])[:, order]
    rest = np.zeros((2, len(order) + 1), columns.dtype)
    rest[0, :-1] = ends.min(axis=0)[::-1].cumsum()[::-1]
    rest[1, :-1] = ends.max(axis=0)[::-1].cumsum()[::-1]
    score = np.zeros(len(alive), columns.dtype)
    for at in range(0, len(order), STEP):
        dims = order[at : at + STEP]
        if 4 * len(alive) > columns.shape[1]:  # whole columns are read faster than chosen rows
            score += (anchor[dims] @ columns[dims])[alive]
        else:
            score += anchor[dims] @ columns[np.ix_(dims, alive)]
        done = min(at + STEP, len(order))
        stay = inside(score, ranges(score, rest[0, done].item(), rest[1, done].item()))
        if not stay.all():
            alive, score = alive[stay], score[stay]
            if not len(alive):
                break
    return alive, score


def inside(score: np.ndarray, ranges: list[tuple]) -> np.ndarray:
    stay = np.zeros(len(score), bool)
    for low, high in ranges:
        stay |= (score >= low) if high is None else (score >= low) & (score <= high)
    return stay


def among_best(count: int) -> Callable:
    """Sums that may be among the ``count`` best: not surely below as many others."""

    def ranges(score, least, most):
        if len(score) <= count:
            return [(score.min(), None)]
        return [(np.partition(score, len(score) - count)[len(score) - count].item() + least - most, None)]

    return ranges


def among_windows(windows: list[tuple[int, int]], count: int) -> Callable:
    """Sums that may be among the ``count`` best inside one of the windows."""

    def ranges(score, least, most):
        found = []
        for a, b in windows:
            low = a - most
            if most - least <= b - a:  # a score can be surely inside
                sure = score[(score >= a - least) & (score <= b - most)]
                if len(sure) >= count:
                    low = max(low, np.partition(sure, len(sure) - count)[len(sure) - count].item() + least - most)
            found.append((low, b - least))
        merged = []
        for low, high in sorted(found):
            if merged and low <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        return merged

    return ranges


def best(block: Block, alive: np.ndarray, score: np.ndarray, count: int) -> list[tuple]:
    """The ``count`` best of them: (row, id, score); ties by id, then row."""
    order = np.lexsort((block.rows[alive], block.ids[alive], -score))[:count]
    return [(int(block.rows[alive[k]]), int(block.ids[alive[k]]), int(score[k])) for k in order]


def same_label(block: Block, columns: np.ndarray, anchor: np.ndarray, own: dict, task: Task):
    a, b = block.span(own["label"])
    alive = np.arange(a, b)
    alive = alive[block.rows[alive] != own["row"]]
    if len(alive):
        limits = tuple(x[: len(columns)] for x in block.limits(a, b))
        for found in best(block, *scan(columns, limits, anchor, alive, among_best(task.positives)), task.positives):
            yield (own["row"], 0, *found)


def other_labels(block: Block, columns: np.ndarray, anchor: np.ndarray, own: dict, task: Task):
    a, b = block.span(own["label"])
    alive = np.concatenate([np.arange(a), np.arange(b, len(block.rows))])
    windows = {s: w for s in own["scores"] if (w := task.window(s))[0] <= w[1]}
    if len(alive) and windows:
        limits = tuple(x[: len(columns)] for x in block.limits(0, len(block.rows)))
        alive, score = scan(columns, limits, anchor, alive, among_windows(list(windows.values()), task.negatives))
        for positive, (low, high) in windows.items():
            fits = inside(score, [(low, high)])
            for found in best(block, alive[fits], score[fits], task.negatives):
                yield (own["row"], positive, *found)


# -- blocks against groups of anchors --------------------------------------------------------------------


def scanned(blocks: DataFrame, anchors: DataFrame, work: Callable, task: Task, cells: tuple[int, int]) -> DataFrame:
    """``anchor``, ``positive`` (a score), ``row``, ``id``, ``score`` from every block and group of anchors.

    A block meets each group of anchors once; both have a bounded number of rows.
    """
    n_blocks, n_groups = cells
    met = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).join(anchors, "part")
    met = met.repartition(max(1, min(n_blocks * n_groups, TASKS)), "block", "part").select("items", "anchors")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                items, group = (batch.column(c).slice(k, 1).flatten() for c in ("items", "anchors"))
                block = Block(items.field("vec"), *(items.field(c).to_numpy() for c in ("label", "id", "row")))
                columns, vectors = suited(block.columns, matrix(group.field("vec")))
                block.columns = columns
                wanted = group.field("row").to_numpy(), group.field("label").to_numpy(), group.field("scores").to_pylist()
                out = []
                for vector, row, label, scores in zip(vectors, *wanted):
                    out += work(block, columns, vector, {"row": int(row), "label": int(label), "scores": scores}, task)
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "positive", "row", "id", "score"])

    return met.mapInArrow(run, "anchor long, positive long, `row` long, id long, score long")


def first_ones(found: DataFrame, by: list[str], count: int) -> DataFrame:
    """The ``count`` best of each ``by``, with their ``rank``: what blocks found is few rows of each anchor."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def integers(vector: str) -> Column:
    return F.transform(vector, lambda x: F.floor(256 * x.cast("double")).cast("long"))


def whole(vector: str) -> Column:
    """Is the vector there, with finite components only?"""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def mine(rows: DataFrame, is_anchor: Column, task: Task = Task(), vector: str = "embedding", label: str = "label", vec_id: str = "vec_id", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``is_anchor`` is a condition on ``rows``. Rows with a null id, label or vector, or a component that
    is null or not finite, take no part. Components become floor(256 * x); shorter vectors count as
    padded with 0; scores beyond 64 bits raise an error. Ties go to the smaller id. Rows that repeat an
    id are rows of their own, also as anchors. An anchor alone in its label, or without a row inside a
    window, has no result rows, and an empty table none. Other columns of ``rows`` are not read.
    """
    some = rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & whole(vector))
    some = some.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), integers(vector).alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    items = stage(some.withColumn("row", F.monotonically_increasing_id()), "bond-rows")
    n_rows, n_anchors = items.agg(F.count("*"), F.count_if("asks")).first()
    cells = max(1, -(-n_rows // block)), max(1, -(-n_anchors // group))
    place = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    blocks = items.groupBy(place(cells[0]).alias("block")).agg(F.collect_list(F.struct("row", "id", "label", "vec")).alias("items"))
    blocks = stage(blocks, "bond-blocks")
    asking = items.where("asks").select("row", "id", "label", "vec")

    def grouped(anchors: DataFrame) -> DataFrame:
        return anchors.groupBy(place(cells[1]).alias("part")).agg(F.collect_list(F.struct("row", "label", "vec", "scores")).alias("anchors"))

    plain = asking.withColumn("scores", F.array().cast("array<long>"))
    near = first_ones(scanned(blocks, grouped(plain), same_label, task, cells), ["anchor"], task.positives)
    near = stage(near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive")), "bond-positives")
    windows = near.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("positive").alias("scores"))
    hard = first_ones(scanned(blocks, grouped(asking.join(windows, "row")), other_labels, task, cells), ["anchor", "positive"], task.negatives)
    named = asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    found = near.join(hard.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}), ["anchor", "positive"]).join(named, "anchor")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("positive").alias("positive_score"), "negative_score")
