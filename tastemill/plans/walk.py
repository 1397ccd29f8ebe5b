"""Personalised random walks on the user-item graph."""

from __future__ import annotations

from math import ceil, log, sqrt

from pyspark.sql import Column, DataFrame, functions as F

from tastemill.functions.vectors import zeros
from tastemill.operators.index import dense_index
from tastemill.operators.rank import top_n_with_zeros, unseen
from tastemill.operators.skew import lookup
from tastemill.operators.spmm import SparseMatrix
from tastemill.session import stage, unstage

# Source users that share one block of vectors.
BLOCK = 32


def graph_edges(ratings: DataFrame, rate_limit: float = 0.0, value: str = "centred") -> DataFrame:
    """(user_id, item_id) of the ratings at or above the limit."""
    return ratings.where(F.col(value) >= rate_limit).select("user_id", "item_id")


def degrees(edges: DataFrame, key: str) -> DataFrame:
    return edges.groupBy(key).agg(F.count(F.lit(1)).alias("degree"))


def transitions(edges: DataFrame) -> DataFrame:
    """Edges with the step probabilities user -> item (``p_item``) and item -> user (``p_user``)."""
    of_user = degrees(edges, "user_id").withColumnRenamed("degree", "user_degree")
    of_item = degrees(edges, "item_id").withColumnRenamed("degree", "item_degree")
    rows = lookup(edges, of_user, "user_id", ["item_id"])
    rows = lookup(stage(rows, "edges"), of_item, "item_id", ["user_id"])
    return rows.withColumns({"p_item": 1 / F.col("user_degree"), "p_user": 1 / F.col("item_degree")})


def step_weights(alpha: float, tolerance: float) -> list[float]:
    """Chebyshev weights that solve w = alpha^2 C C' w + b to the tolerance.

    The spectrum of alpha^2 C C' lies in [0, alpha^2]; the error shrinks by about 4 per
    two-hop step for alpha = 0.8, where summing the plain walk would shrink it by 1.6.
    """
    sigma = alpha**2 / (2 - alpha**2)
    rate = sigma / (1 + sqrt(1 - sigma**2))
    count = max(2, ceil(log(tolerance / 2) / log(rate)))
    weights = [1.0, 2 / (2 - sigma**2)]
    while len(weights) < count:
        weights.append(1 / (1 - sigma**2 * weights[-1] / 4))
    return weights


def walk_scores(
    edges: DataFrame,
    sources: DataFrame,
    alpha: float = 0.8,
    tolerance: float = 1e-12,
    semantics: str = "reference",
    block: int = BLOCK,
) -> DataFrame:
    """(user_id, item_id, score) of every item a source user can reach.

    With C = D_u^-1/2 A D_s^-1/2 the walk matrix is similar to a symmetric one, and

        score(u, s) = alpha * sqrt(deg u / deg s) * [C' (I - alpha^2 C C')^-1 e_u]_s
                    = alpha * sqrt(deg u / deg s) * [(I - alpha^2 C' C)^-1 C' e_u]_s

    is the reference's entry; ``corrected`` scales with sqrt(deg s / deg u) instead, which
    is the walk from u to s. The inverse is only ever formed for the smaller side: for
    the source users, or for the items followed by one product with C. Its columns are
    held in blocks of vectors, so one pass over the edges serves ``block`` of them.
    """
    moves = stage(transitions(edges), "walk-edges")
    weighted = moves.withColumn("c", 1 / F.sqrt(F.col("user_degree") * F.col("item_degree")))
    matrix = SparseMatrix(weighted, "user_id", "item_id", "c")
    of_user = stage(moves.select("user_id", "user_degree").distinct(), "walk-users")
    of_item = stage(moves.select("item_id", "item_degree").distinct(), "walk-items")
    starts = of_user.join(sources.select("user_id"), "user_id", "left_semi")
    by_item = of_item.count() < starts.count()
    side, columns, nodes = ("item_id", of_item, of_item) if by_item else ("user_id", starts, of_user)
    place = dense_index(columns, side)
    index = stage(
        columns.join(place, side).select(
            "*", F.floor(F.col("pos") / block).alias("blk"), F.pmod("pos", F.lit(block)).cast("int").alias("slot")
        ),
        "walk-columns",
    )
    state = _inverse_columns(matrix, nodes, index.select("blk", side, "slot"), side, alpha, tolerance, block)
    if by_item:
        reach = matrix.times(state, block, ["blk"]).join(starts, "user_id")
    else:
        reach = matrix.transposed_times(state, block, ["blk"]).join(of_item, "item_id")
    ratio = F.col("user_degree") / F.col("item_degree")
    if semantics == "corrected":
        ratio = F.col("item_degree") / F.col("user_degree")
    return (
        reach.select("*", F.posexplode("vec").alias("slot", "_value"))
        .where(F.col("_value") > 0)
        .join(index, ["blk", "slot"])
        .select("user_id", "item_id", (F.lit(alpha) * F.col("_value") * F.sqrt(ratio)).alias("score"))
    )


def _inverse_columns(
    matrix: SparseMatrix, nodes: DataFrame, index: DataFrame, side: str, alpha: float, tolerance: float, block: int
) -> DataFrame:
    """(blk, node, vec): columns of (I - alpha^2 N)^-1, N being the two-hop step on one side."""
    blocks = max(1, ceil(index.count() / block))
    gamma = 2 / (2 - alpha**2)
    first, *weights = step_weights(alpha, tolerance)
    state = (
        nodes.select(side)
        .withColumn("blk", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
        .join(index, ["blk", side], "left")
        .select("blk", side, "slot", _plus_start(zeros(block), first * gamma).alias("vec"), zeros(block).alias("prev"))
    )
    state = stage(state, "walk-step")
    for omega in weights:
        if side == "item_id":
            back = matrix.transposed_times(matrix.times(state, block, ["blk"]), block, ["blk"])
        else:
            back = matrix.times(matrix.transposed_times(state, block, ["blk"]), block, ["blk"])
        known = F.zip_with("vec", "prev", lambda w, p: omega * (1 - gamma) * w + (1 - omega) * p)
        step = F.zip_with(known, "_back", lambda m, h: m + omega * gamma * alpha**2 * h)
        before, state = state, stage(
            state.join(back.withColumnRenamed("vec", "_back"), ["blk", side]).select(
                "blk", side, "slot", _plus_start(step, omega * gamma).alias("vec"), F.col("vec").alias("prev")
            ),
            "walk-step",
        )
        unstage(before)
    return state


def _plus_start(vec: Column, amount: float) -> Column:
    """Add ``amount`` at the slot of the source the row stands for, if it is one."""
    return F.when(F.col("slot").isNull(), vec).otherwise(
        F.transform(vec, lambda x, i: F.when(i == F.col("slot"), x + amount).otherwise(x))
    )


def recommend_walk(
    scores: DataFrame, users: DataFrame, items: DataFrame, n: int = 10, seen: DataFrame | None = None
) -> DataFrame:
    """Top-N of the walk scores; items out of reach count with score 0."""
    scores = stage(scores, "walk-scores")
    taken = scores.select("user_id", "item_id")
    if seen is None:
        return top_n_with_zeros(scores, taken, users, items, n)
    taken = taken.unionByName(seen.select("user_id", "item_id")).distinct()
    return top_n_with_zeros(unseen(scores, seen), taken, users, items, n)
