"""Top-N lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tastemill.operators.skew import sizes_of
from tastemill.session import stage

# Positions of a catalogue that are counted together when free items are looked for.
SPAN = 1024
# Sums of terms of both signs that come out below this are rounding noise of a true 0.
NOISE = 1e-12


def ordering(score: Column) -> Column:
    """What lists are ranked on: the score to 24 significant bits, whatever its size.

    Scores that differ only by the order of a sum tie; small scores keep their order.
    """
    return score.cast("float") + F.lit(0.0).cast("float")


def settled(score: Column) -> Column:
    """A sum of terms of both signs, with rounding noise around 0 taken away."""
    return F.when(F.abs(score) < NOISE, F.lit(0.0)).otherwise(score)


def top_n(scores: DataFrame, n: int = 10, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """(user, rank, item, score): the ``n`` best rows per user, ties by item.

    The rank filter becomes a per-task group limit before the shuffle, so no user sends
    more than ``n`` rows per task however many candidates they have.
    """
    order = Window.partitionBy(user).orderBy(F.desc("_order"), F.asc(item))
    return (
        scores.select(user, item, "score", ordering(F.col("score")).alias("_order"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select(user, "rank", item, "score")
    )


def unseen(scores: DataFrame, seen: DataFrame) -> DataFrame:
    return scores.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def seen_only(scores: DataFrame, seen: DataFrame) -> DataFrame:
    return scores.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")


def top_n_with_zeros(
    candidates: DataFrame, taken: DataFrame, users: DataFrame, items: DataFrame, n: int = 10
) -> DataFrame:
    """Top-N where every catalogue item without a row in ``taken`` counts with score 0.

    ``candidates`` (user, item, score) are the scored rows that may be listed, ``taken``
    (user, item) all rows that are scored or must not be listed. Only users with fewer
    than ``n`` positive candidates can need an item of score 0.
    """
    positive = sizes_of(candidates.where(F.col("score") > 0).select("user_id"), "user_id")
    short = users.select("user_id").distinct().join(positive.where(F.col("n") >= n), "user_id", "left_anti")
    short = stage(short, "short-users")
    if short.isEmpty():
        return top_n(candidates, n)
    held = stage(taken.select("user_id", "item_id").join(short, "user_id", "left_semi"), "held")
    catalogue = items.select("item_id", F.lit(0.0).alias("score")).distinct()
    return top_n(candidates.unionByName(first_free(catalogue, held, short, n)), n)


def ranked_index(catalogue: DataFrame) -> DataFrame:
    """(item_id, score, pos): places 0.. by falling score, ties by id, without one sorting task."""
    order = [F.desc("_order"), F.asc("item_id")]
    dealt = catalogue.select("item_id", "score", ordering(F.col("score")).alias("_order"))
    parts = max(1, min(200, dealt.count() // 10_000))
    dealt = stage(dealt.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "catalogue")
    sizes = sorted((r["_part"], r["n"]) for r in sizes_of(dealt, "_part").collect())  # a row for each part
    starts = [(part, sum(n for _, n in sizes[:k])) for k, (part, _) in enumerate(sizes)]
    first = dealt.sparkSession.createDataFrame(starts, "_part int, _first long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = dealt.join(F.broadcast(first), "_part").withColumn("pos", F.col("_first") + inside - 1)
    return placed.select("item_id", "score", "pos")


def first_free(catalogue: DataFrame, taken: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
    """(user, item, score): for each user the ``n`` first catalogue items not among ``taken``.

    The catalogue (item_id, score) gets places by score and id. Per user the taken places
    are counted in spans of places; gaps between those spans, and inside the spans before
    which fewer than ``n`` places are free, give the free places. So the work is linear in
    the taken rows, no list grows with the catalogue and the number of jobs is fixed.
    """
    index = stage(ranked_index(catalogue), "catalogue-places")
    size = index.count()
    known = users.select("user_id").distinct()
    placed = taken.select("user_id", "item_id").distinct().join(index.select("item_id", "pos"), "item_id")
    placed = placed.join(known, "user_id", "left_semi")
    placed = stage(placed.select("user_id", "pos", F.floor(F.col("pos") / SPAN).alias("_span")), "taken-places")

    by_span = Window.partitionBy("user_id").orderBy("_span")
    spans = placed.groupBy("user_id", "_span").agg(F.count(F.lit(1)).alias("_held"))
    before = F.coalesce(F.sum("_held").over(by_span.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(
        "user_id", "_span", "_held",
        (F.col("_span") * SPAN - before).alias("_free"),
        F.lead("_span").over(by_span).alias("_next"),
        F.row_number().over(by_span).alias("_nth"),
    )
    spans = stage(spans.where((F.col("_free") < n) | (F.col("_nth") == 1)), "open-spans")

    after = (F.col("_span") + 1) * SPAN  # the places up to the next span with a taken one
    gaps = spans.select(
        "user_id",
        after.alias("start"),
        (F.coalesce(F.col("_next") * SPAN, F.lit(size)) - after).alias("length"),
        (F.col("_free") + SPAN - F.col("_held")).alias("free"),
    )
    head = spans.where("_nth = 1").select("user_id", F.lit(0).cast("long").alias("start"), (F.col("_span") * SPAN).alias("length"), F.lit(0).cast("long").alias("free"))
    nothing = known.join(spans.select("user_id").distinct(), "user_id", "left_anti")
    whole = nothing.select("user_id", F.lit(0).cast("long").alias("start"), F.lit(size).cast("long").alias("length"), F.lit(0).cast("long").alias("free"))

    inside = Window.partitionBy("user_id", "_span").orderBy("pos")
    open_spans = spans.where(F.col("_free") < n).select("user_id", "_span", "_free")
    places = placed.join(open_spans, ["user_id", "_span"]).withColumn("_rank", F.row_number().over(inside))
    end = F.least((F.col("_span") + 1) * SPAN, F.lit(size))
    until = F.coalesce(F.lead("pos").over(inside), end)
    between = places.select(
        "user_id",
        (F.col("pos") + 1).alias("start"),
        (until - F.col("pos") - 1).alias("length"),
        (F.col("_free") + F.col("pos") + 1 - F.col("_span") * SPAN - F.col("_rank")).alias("free"),
    )
    ahead = places.where("_rank = 1").select(
        "user_id", (F.col("_span") * SPAN).alias("start"), (F.col("pos") - F.col("_span") * SPAN).alias("length"), F.col("_free").alias("free")
    )
    ranges = gaps
    for more in (head, whole, between, ahead):
        ranges = ranges.unionByName(more)
    take = F.least(F.col("length"), F.lit(n) - F.col("free"))
    free = ranges.where((F.col("length") > 0) & (F.col("free") < n)).select(
        "user_id", F.explode(F.sequence(F.col("start"), F.col("start") + take - 1)).alias("pos")
    )
    return free.join(index, "pos").select("user_id", "item_id", "score")
