"""Alternating least squares where a missing rating is an observed 0, and the masked variant."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, functions as F

from tastemill.functions.encode import hex_number
from tastemill.functions.vectors import dot, gram, times_matrix
from tastemill.operators.index import dense_index
from tastemill.operators.skew import lookup
from tastemill.operators.spmm import SparseMatrix
from tastemill.plans.factors import Factors
from tastemill.session import stage, unstage


def hashed_start(seed: str) -> Callable[[str, int], Column]:
    """Start values in [0, 1) from a hash of the id, the same on every run."""

    def start(key: str, k: int) -> Column:
        draws = [hex_number(F.concat_ws("-", F.lit(seed), F.lit(f), F.col(key).cast("string")), 8) for f in range(k)]
        return F.array(*[d / F.lit(2.0**32) for d in draws])

    return start


def als_dense(
    ratings: DataFrame,
    users: DataFrame,
    items: DataFrame,
    k: int,
    steps: int = 1000,
    epoch: float = 1e-5,
    lambda_u: float = 0.01,
    lambda_i: float = 0.01,
    value: str = "centred",
    semantics: str = "corrected",
    start: Callable[[str, int], Column] | None = None,
    keep_history: bool = False,
) -> Factors:
    """Factorise the zero-filled matrix; stop after ``steps`` or when the loss is below ``epoch``.

    One sweep is two sparse products and two k x k sums. The k x k inverse is applied to
    the factors before they are joined to the ratings. The loss needs no dense matrix:
    sum r^2 - 2 sum r (u . i) + trace((U'U)(I'I)) + penalties.

    ``semantics="reference"`` only ever updates the first ``k`` items, as the code this
    reproduces does.
    """
    start = start or hashed_start("start")
    matrix = SparseMatrix(ratings, "user_id", "item_id", value)
    square = matrix.cells.agg(F.sum(F.col("_value") * F.col("_value"))).first()[0] or 0.0
    eye = np.eye(k)

    def with_cross(u: DataFrame, i: DataFrame) -> float:
        z = matrix.transposed_times(u, k).withColumnRenamed("vec", "z")
        return i.join(z, "item_id").agg(F.sum(dot(F.col("vec"), F.col("z")))).first()[0] or 0.0

    def loss(cross: float, gu: np.ndarray, gi: np.ndarray) -> float:
        return float(square - 2 * cross + (gu * gi).sum() + lambda_u * np.trace(gu) + lambda_i * np.trace(gi))

    u = stage(users.select("user_id", start("user_id", k).alias("vec")), "als-users")
    i = stage(items.select("item_id", start("item_id", k).alias("vec")), "als-items")
    gi = gram(i, "vec", k)
    losses = [loss(with_cross(u, i), gram(u, "vec", k), gi)]
    history = [(u, i)]
    trained = items.select("item_id").orderBy("item_id").limit(k).withColumn("_trained", F.lit(True))

    for _ in range(steps):
        before = (u, i)
        u = stage(matrix.times(times_matrix(i, "vec", np.linalg.inv(gi + lambda_u * eye)), k), "als-users")
        gu = gram(u, "vec", k)
        z = matrix.transposed_times(u, k).withColumn("z", F.col("vec"))
        fresh = times_matrix(z, "vec", np.linalg.inv(gu + lambda_i * eye))
        if semantics == "reference":
            zero = F.array_repeat(F.lit(0.0), k)
            fresh = (
                i.select("item_id", F.col("vec").alias("_before"))
                .join(fresh, "item_id", "left")
                .join(F.broadcast(trained), "item_id", "left")
                .select(
                    "item_id",
                    F.when(F.col("_trained"), F.coalesce("vec", zero)).otherwise(F.col("_before")).alias("vec"),
                    F.coalesce("z", zero).alias("z"),
                )
            )
        i = stage(fresh.select("item_id", "vec", "z"), "als-items")
        cross = i.agg(F.sum(dot(F.col("vec"), F.col("z")))).first()[0] or 0.0
        i = i.select("item_id", "vec")
        gi = gram(i, "vec", k)
        losses.append(loss(cross, gu, gi))
        history = history + [(u, i)] if keep_history else [(u, i)]
        if not keep_history:
            for factors in before:
                unstage(factors)
        if losses[-1] < epoch:
            break
    return Factors(u, i, k, losses, history)


def als_masked(ratings: DataFrame, k: int, steps: int = 10, penalty: float = 0.1, value: str = "centred", seed: int = 7) -> Factors:
    """Spark's own ALS, which leaves missing ratings out instead of reading them as 0.

    It takes 32-bit ids, so both sides are numbered from 0 and named again afterwards.
    """
    places = {key: stage(dense_index(ratings, key, name=f"{key}_at"), "als-places") for key in ("user_id", "item_id")}
    rows = ratings.select("user_id", "item_id", F.col(value).cast("float").alias(value))
    for key, other in (("user_id", "item_id"), ("item_id", "user_id_at")):
        rows = lookup(stage(rows, "als-rows"), places[key], key, [other]).drop(key)
    trainer = ALS(
        rank=k,
        maxIter=steps,
        regParam=penalty,
        userCol="user_id_at",
        itemCol="item_id_at",
        ratingCol=value,
        seed=seed,
        checkpointInterval=-1,
    )
    model = trainer.fit(rows.select(F.col("user_id_at").cast("int"), F.col("item_id_at").cast("int"), value))

    def named(side: DataFrame, key: str) -> DataFrame:
        plain = side.select(F.col("id").cast("long").alias(f"{key}_at"), F.col("features").cast("array<double>").alias("vec"))
        return plain.join(places[key], f"{key}_at").select(key, "vec")

    return Factors(named(model.userFactors, "user_id"), named(model.itemFactors, "item_id"), k)
