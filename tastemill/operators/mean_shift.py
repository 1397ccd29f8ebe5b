"""Baskets by mean-shift clustering of each user's rating times."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tastemill.operators.baskets import with_size
from tastemill.operators.skew import hot_keys
from tastemill.schema import SECONDS_PER_DAY
from tastemill.session import stage

STOP_SHARE = 1e-3  # a seed rests when it moves less than this share of the bandwidth
MAX_STEPS = 300
# Distances to two centres that differ by less (seconds) are equal; the stronger centre wins.
TIE = 1e-3
# Users with more ratings than this are clustered slab by slab.
MAX_USER_ROWS = 500_000


def shift_seeds(
    times: np.ndarray,
    weights: np.ndarray,
    seeds: np.ndarray,
    steps: np.ndarray,
    bandwidth: float,
    low: float = -np.inf,
    high: float = np.inf,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Move each seed to the mean of the points within the bandwidth until it rests.

    ``times`` must be sorted. Points are only known inside [low, high); a seed whose
    neighbourhood leaves that range is returned unfinished. Returns positions, points
    within, steps done and a finished flag.
    """
    base = int(times[0])
    count = np.concatenate([[0], np.cumsum(weights)])
    total = np.concatenate([[0], np.cumsum((times - base).astype(np.int64) * weights)])
    centre, steps = seeds.astype(float), steps.copy()
    within = np.zeros(len(centre), dtype=np.int64)
    done = np.zeros(len(centre), dtype=bool)
    active = np.arange(len(centre))
    while len(active):
        at = centre[active]
        known = (at - bandwidth >= low) & (at + bandwidth < high)
        active, at = active[known], at[known]
        first = np.searchsorted(times, at - bandwidth, "left")
        last = np.searchsorted(times, at + bandwidth, "right")
        number = count[last] - count[first]
        mean = base + (total[last] - total[first]) / number
        centre[active], within[active] = mean, number
        rest = (np.abs(mean - at) < STOP_SHARE * bandwidth) | (steps[active] >= MAX_STEPS)
        done[active[rest]] = True
        steps[active] += 1
        active = active[~rest]
    return centre, within, steps, done


def keep_centres(centre: np.ndarray, within: np.ndarray, bandwidth: float) -> np.ndarray:
    """Strongest centres first; a centre within the bandwidth of a kept one is dropped."""
    ranked = centre[np.lexsort((-centre, -within))]
    kept = []
    while len(ranked):
        kept.append(ranked[0])
        ranked = ranked[np.abs(ranked - ranked[0]) > bandwidth]
    return np.asarray(kept)


def nearest_centre(times: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Position in ``kept`` of the nearest centre; the stronger one if two are as near."""
    order = np.argsort(kept)
    ascending = kept[order]
    right = np.clip(np.searchsorted(ascending, times), 0, len(kept) - 1)
    left = np.maximum(right - 1, 0)
    to_left, to_right = np.abs(times - ascending[left]), np.abs(times - ascending[right])
    closer = (to_left < to_right - TIE) | ((np.abs(to_left - to_right) <= TIE) & (order[left] < order[right]))
    return np.where(closer, order[left], order[right])


def cluster_users(users: np.ndarray, times: np.ndarray, bandwidth: float) -> tuple[np.ndarray, np.ndarray]:
    """Cluster number (from 1) and centre per row; rows are sorted by user and time.

    All users go through the shifts at once: each is moved along the time axis so far
    that no other user's points or centres can be near.
    """
    starts = np.flatnonzero(np.r_[True, users[1:] != users[:-1]])
    sizes = np.diff(np.r_[starts, len(users)])
    first = times[starts]
    room = int(np.max(times[starts + sizes - 1] - first) + 3 * bandwidth + 1)
    who = np.repeat(np.arange(len(starts)), sizes)
    moved = times - first[who] + who * room

    points, where = np.unique(moved, return_inverse=True)
    seeds = points.astype(float)
    centre, within, _, _ = shift_seeds(points, np.bincount(where), seeds, np.zeros(len(seeds), int), bandwidth)
    owner = points // room
    distinct = np.unique(np.stack([owner, centre, within], axis=1), axis=0)
    bounds = np.r_[np.searchsorted(distinct[:, 0], np.arange(len(starts))), len(distinct)]
    number, middle = np.zeros(len(points), dtype=np.int64), np.zeros(len(points))
    edges = np.searchsorted(points, np.arange(len(starts) + 1) * room)
    for user in range(len(starts)):
        part = distinct[bounds[user] : bounds[user + 1]]
        kept = keep_centres(part[:, 1], part[:, 2], bandwidth)
        mine = slice(edges[user], edges[user + 1])
        nearest = nearest_centre(seeds[mine], kept)
        number[mine], middle[mine] = nearest + 1, kept[nearest] - user * room + first[user]
    return number[where], middle[where]


def _cluster_batches(bandwidth: float):
    """Cluster whole users out of batches that are sorted by user."""

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows.groupby("user_id")["ts"].transform("size") > 1]
        if rows.empty:
            return pd.DataFrame()
        number, centre = cluster_users(rows["user_id"].to_numpy(), rows["ts"].to_numpy(), bandwidth)
        return rows[["user_id", "item_id"]].assign(basket_no=number, centre=centre)

    def cluster(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if len(batch) == 0:
                continue
            rows = batch if rest is None else pd.concat([rest, batch])
            last = rows["user_id"] == rows["user_id"].iloc[-1]
            rest = rows[last]
            out = label(rows[~last])
            if len(out):
                yield out
        if rest is not None:
            out = label(rest)
            if len(out):
                yield out

    return cluster


LABELS = "user_id long, item_id long, basket_no long, centre double"


def mean_shift_labels(
    ratings: DataFrame, bandwidth_days: float = 25.0, max_user_rows: int = MAX_USER_ROWS
) -> DataFrame:
    """Cluster number and centre (seconds) per rating; users with one rating are skipped."""
    bandwidth = bandwidth_days * SECONDS_PER_DAY
    rows = ratings.select("user_id", "item_id", "ts")
    hot = hot_keys(rows, "user_id", max_user_rows)
    light = rows if hot is None else rows.join(_small(hot.select("user_id")), "user_id", "left_anti")
    ordered = light.repartition("user_id").sortWithinPartitions("user_id", "ts")
    labels = ordered.mapInPandas(_cluster_batches(bandwidth), LABELS)
    if hot is None:
        return labels
    heavy = rows.join(_small(hot.select("user_id")), "user_id", "left_semi")
    return labels.unionByName(_slab_labels(heavy, bandwidth))


def mean_shift_baskets(
    ratings: DataFrame, bandwidth_days: float = 25.0, max_user_rows: int = MAX_USER_ROWS
) -> DataFrame:
    labels = stage(mean_shift_labels(ratings, bandwidth_days, max_user_rows), "shift-labels")
    return with_size(labels.select("user_id", "basket_no", "item_id"), ["user_id", "basket_no"]).select(
        "user_id", "basket_no", "item_id", "basket_size"
    )


# --- users too large for one task -------------------------------------------------------

SLAB_HALO = 2
SLAB_ROWS = "user_id long, slab long, t double, w long, steps int, done boolean"


# Most lists of centres that are broadcast; more of them are joined by user.
MOST_LISTS = 20_000


def _small(lists: DataFrame) -> DataFrame:
    return F.broadcast(lists) if lists.limit(MOST_LISTS + 1).count() <= MOST_LISTS else lists


def _slab_labels(rows: DataFrame, bandwidth: float) -> DataFrame:
    centres = stage(_kept_centres(_slab_centres(rows, bandwidth), bandwidth), "shift-kept")
    # Kept centres are more than a bandwidth apart: at most time span / bandwidth per user.
    order = F.array_sort(
        F.collect_list(F.struct((-F.col("w")).alias("w"), (-F.col("t")).alias("t"))),
    )
    lists = centres.groupBy("user_id").agg(F.transform(order, lambda c: -c["t"]).alias("_kept"))
    distance = F.transform("_kept", lambda c: F.round(F.abs(c - F.col("ts")), 3))
    return (
        rows.join(_small(lists), "user_id")
        .withColumn("basket_no", F.array_position(distance, F.array_min(distance)))
        .select("user_id", "item_id", "basket_no", F.element_at("_kept", F.col("basket_no").cast("int")).alias("centre"))
    )


def _slab_centres(rows: DataFrame, bandwidth: float) -> DataFrame:
    """Resting places (user_id, t, w) of the seeds of heavy users.

    The time axis is cut into slabs one bandwidth wide. A task holds the distinct times
    of one slab and two neighbours on each side, so its size depends on the bandwidth
    and not on the user. Seeds that drift out of the known range continue in the next
    round in the slab they have reached.
    """
    points = stage(rows.groupBy("user_id", "ts").agg(F.count(F.lit(1)).alias("w")), "shift-points")
    slab = F.floor(F.col("t") / bandwidth).cast("long")
    around = F.sequence(F.col("slab") - SLAB_HALO, F.col("slab") + SLAB_HALO)
    spread = (
        points.select("user_id", F.col("ts").cast("double").alias("t"), "w")
        .withColumn("slab", slab)
        .withColumn("slab", F.explode(around))
        .select("user_id", "slab", "t", "w", F.lit(-1).alias("steps"))
    )
    seeds = points.select("user_id", F.col("ts").cast("double").alias("t"), F.lit(0).alias("steps"))
    result = None
    while True:
        placed = seeds.withColumn("slab", slab).select("user_id", "slab", "t", F.lit(0).cast("long").alias("w"), "steps")
        busy = placed.select("user_id", "slab").distinct()
        moved = stage(
            spread.join(busy, ["user_id", "slab"], "left_semi")
            .unionByName(placed)
            .groupBy("user_id", "slab")
            .applyInPandas(_shift_slab(bandwidth), SLAB_ROWS),
            "shift-round",
        )
        rested = moved.where("done").select("user_id", "t", "w")
        result = rested if result is None else result.unionByName(rested)
        seeds = moved.where("not done").select("user_id", "t", "steps").distinct()
        if seeds.isEmpty():
            return stage(result.distinct(), "shift-centres")


def _shift_slab(bandwidth: float):
    def shift(rows: pd.DataFrame) -> pd.DataFrame:
        is_seed = rows["steps"].to_numpy() >= 0
        points = rows[~is_seed].sort_values("t")
        seeds = rows[is_seed]
        slab = int(rows["slab"].iloc[0])
        centre, within, steps, done = shift_seeds(
            points["t"].to_numpy().astype(np.int64),
            points["w"].to_numpy(),
            seeds["t"].to_numpy(),
            seeds["steps"].to_numpy(),
            bandwidth,
            (slab - SLAB_HALO) * bandwidth,
            (slab + SLAB_HALO + 1) * bandwidth,
        )
        out = pd.DataFrame({"t": centre, "w": np.where(done, within, 0), "steps": steps, "done": done})
        out["steps"] = np.where(done, 0, out["steps"])
        out = out.drop_duplicates()
        out["user_id"], out["slab"] = rows["user_id"].iloc[0], slab
        return out[["user_id", "slab", "t", "w", "steps", "done"]]

    return shift


def _kept_centres(centres: DataFrame, bandwidth: float) -> DataFrame:
    """Strongest-first suppression in rounds over cells one bandwidth wide.

    Two centres in a cell are always within the bandwidth, so a cell keeps at most one.
    The best open centre of a cell is kept once it beats the best of both neighbour
    cells; everything within the bandwidth of it is then closed. The strongest open
    centre of all always qualifies, so each round makes progress.
    """
    cell = F.floor(F.col("t") / bandwidth).cast("long")
    by_cell = Window.partitionBy("user_id").orderBy("cell")

    def beats(step) -> Column:
        other, near = step("best").over(by_cell), step("cell").over(by_cell)
        return near.isNull() | (F.abs(near - F.col("cell")) > 1) | (F.col("best") > other)

    kept, open_ = None, centres
    while True:
        best = open_.withColumn("cell", cell).groupBy("user_id", "cell").agg(F.max(F.struct("w", "t")).alias("best"))
        winners = stage(
            best.withColumn("_wins", beats(F.lag) & beats(F.lead)).where("_wins").select("user_id", "best.*"),
            "shift-kept",
        )
        if winners.isEmpty():
            return kept
        kept = winners if kept is None else kept.unionByName(winners)
        lists = kept.groupBy("user_id").agg(F.collect_list("t").alias("_kept"))
        open_ = (
            centres.join(_small(lists), "user_id", "left")
            .where(~F.coalesce(F.exists("_kept", lambda k: F.abs(k - F.col("t")) <= bandwidth), F.lit(False)))
            .drop("_kept")
        )
