"""Personalised random walks by forward push: sparse state, a stated error, lists for chosen sources.

A source starts with a residual of 1 at itself. Pushing a node adds its residual to the node's
estimate and hands ``alpha`` times it on, in equal shares, to the neighbours. Nodes whose residual is
at most ``eps * degree`` stay: since alpha * P keeps degrees within alpha times themselves, what all
residuals together could still add to a node of degree d is at most eps * d / (1 - alpha). With
eps = tolerance * (1 - alpha) / degree(source) every score is right to ``tolerance``.

Only nodes with something to push are touched, so a source costs what it reaches and not nodes
squared. While the graph is small enough to broadcast (``GRAPH_EDGES``, counted first), tasks push
batches of sources on it; beyond that the residuals are a table and a round is a join.

Many sources would each cross all edges of the items they reach. Where sources outnumber the items and
items meet in few pairs (``GRAPH_PAIRS``, counted first), two steps are taken as one, from item to item:
tasks hold the pairs, and a source starts with what its own first push leaves on its items. The walk from
item to item keeps degrees within alpha**2 times themselves, so the same bound holds with alpha**2.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tastemill.operators.rank import ordering
from tastemill.operators.skew import lookup
from tastemill.plans.walk import transitions
from tastemill.session import stage, unstage

# Edges (16 bytes each) up to which tasks hold the graph.
GRAPH_EDGES = 2_000_000
# Pairs of items with a common user (16 bytes each) up to which tasks hold them, and rows that may be joined
# for each edge to form them.
GRAPH_PAIRS, PAIR_ROWS = 4_000_000, 256
# Sources of one task on pairs. While there are no more items than that, the task keeps what each item as a source gives.
TASK_SOURCES = 2_000
# Share of the nodes above which a round works on whole arrays.
DENSE = 8
SCORES = "user_id long, item_id long, score double, bound double, held long"


class Graph(NamedTuple):
    """Nodes are users, then items, each in order of their ids; neighbours of v are ``ends[starts[v]:starts[v + 1]]``."""

    users: np.ndarray
    items: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, user: np.ndarray, item: np.ndarray) -> Graph:
        users, u = np.unique(user, return_inverse=True)
        items, i = np.unique(item, return_inverse=True)
        i = i + len(users)
        order = np.argsort(np.concatenate([u, i]), kind="stable")
        degree = np.bincount(np.concatenate([u, i]), minlength=len(users) + len(items))
        return cls(users, items, np.concatenate([[0], np.cumsum(degree)]), np.concatenate([i, u])[order].astype(np.int32))


def pushed(graph: Graph, source: int, alpha: float, eps: float, frontier: int | None = None) -> tuple[np.ndarray, float, int]:
    """Estimates of all nodes, the largest (residual + dropped) / degree left, and nodes that held a residual.

    With ``frontier`` only that many of the largest residuals go on after a round; the others are
    dropped, and count in what is left.
    """
    return _settled(graph.starts, graph.ends, None, np.diff(graph.starts), np.array([source]), 1.0, alpha, eps, frontier)


def _settled(starts, ends, weights, degree, active, first_amount, alpha, eps, frontier=None) -> tuple[np.ndarray, float, int]:
    """``pushed`` from ``first_amount`` at each of the nodes ``active``; edge e hands on ``weights[e] / degree`` (None: 1)."""
    n = len(degree)
    estimate, residual, dropped = np.zeros(n), np.zeros(n), np.zeros(n)
    residual[active] = first_amount
    least = eps * degree
    held = np.zeros(n, bool)
    held[active] = True
    active = active[residual[active] > least[active]]
    edges_of = np.diff(starts)
    while len(active):
        held[active] = True
        amount = residual[active]
        estimate[active] += amount
        residual[active] = 0.0
        many = edges_of[active]
        edge = np.repeat(starts[active] - (np.cumsum(many) - many), many)
        edge += np.arange(len(edge))
        to = ends[edge]
        share = np.repeat(alpha * amount / degree[active], many)
        if weights is not None:
            share *= weights[edge]
        if DENSE * len(to) > n:
            residual += np.bincount(to, share, n)
            active = np.flatnonzero(residual > least)
        else:
            np.add.at(residual, to, share)
            reached = np.unique(to)
            active = reached[residual[reached] > least[reached]]
        if frontier is not None and len(active) > frontier:
            keep = np.argpartition(-residual[active], frontier)
            lost = active[keep[frontier:]]
            dropped[lost] += residual[lost]
            residual[lost] = 0.0
            active = np.sort(active[keep[:frontier]])
    held |= residual > 0
    return estimate, float(((residual + dropped) / np.maximum(degree, 1)).max(initial=0.0)), int(held.sum())


def push_scores(
    edges: DataFrame,
    sources: DataFrame,
    alpha: float = 0.8,
    tolerance: float = 1e-9,
    semantics: str = "reference",
    top: int | None = None,
    frontier: int | None = None,
    graph_edges: int | None = None,
    graph_pairs: int | None = None,
) -> DataFrame:
    """(user_id, item_id, score, bound, held) of the items that each source reaches, or of its ``top`` best.

    The score is the walk matrix' entry [user, item]; ``corrected`` gives that from user to item.
    ``bound`` is the largest error of the source's scores (estimates are never too high), at most
    ``tolerance`` unless ``frontier`` drops residuals. ``held`` counts the nodes with state. Sources
    without edges have no rows. ``edges`` and ``sources`` are tables without repeated rows.
    """
    count, most = edges.count(), GRAPH_EDGES if graph_edges is None else graph_edges
    if frontier is None:
        wanted = stage(sources.select("user_id").distinct(), "push-wanted")
        pairs = _item_pairs(edges, wanted, count, count > most, GRAPH_PAIRS if graph_pairs is None else graph_pairs)
        if pairs is not None:
            return _by_pairs(edges, wanted, pairs, alpha, tolerance, semantics, top)
    if count > most:
        if frontier is not None:
            raise ValueError("a bounded frontier needs a graph that tasks can hold")
        return _by_rounds(edges, sources, alpha, tolerance, semantics, top)
    table = edges.select("user_id", "item_id").toArrow()  # at most GRAPH_EDGES rows
    graph = Graph.of(table.column(0).to_numpy(), table.column(1).to_numpy())
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(tuple(graph))

    def run(batches):
        graph = Graph(*shared.value)
        degree = np.diff(graph.starts)
        users = len(graph.users)
        of_item = degree[users:]
        for batch in batches:
            out = []
            for user in batch.column(0).to_pylist():
                at = int(np.searchsorted(graph.users, user))
                if at == users or graph.users[at] != user:
                    continue
                own = float(degree[at]) if semantics == "reference" else float(of_item.max())
                estimate, left, held = pushed(graph, at, alpha, tolerance * (1 - alpha) / own, frontier)
                score = estimate[users:]
                if semantics == "reference":
                    score = score * (degree[at] / of_item)
                found = _best(score, top)
                out.append((np.full(len(found), user), graph.items[found], score[found], np.full(len(found), left * own / (1 - alpha)), np.full(len(found), held)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["user_id", "item_id", "score", "bound", "held"])

    wanted = sources.select("user_id").distinct()
    return wanted.repartition(max(8, spark.sparkContext.defaultParallelism), "user_id").mapInArrow(run, SCORES)


def _best(score: np.ndarray, top: int | None) -> np.ndarray:
    """Places above 0, or the ``top`` best of them."""
    found = np.flatnonzero(score > 0)
    if top is None or len(found) <= top:
        return found
    return found[np.lexsort((found, -score[found].astype(np.float32)))[:top]]


def _item_pairs(edges: DataFrame, wanted: DataFrame, count: int, large: bool, most: int) -> DataFrame | None:
    """(item_id, other, weight): the sum of 1 / degree over the users of both; None where pairs do not pay.

    They do if sources outnumber the items, the rows joined for them stay in proportion to the edges, and
    they are few: at most ``most``, and on a graph that tasks could hold fewer than it has edges both ways.
    """
    items = edges.select("item_id").distinct().count()
    if not 0 < items < wanted.count():
        return None
    of_user = stage(edges.groupBy("user_id").agg(F.count(F.lit(1)).alias("degree")), "push-users")
    if of_user.agg(F.sum(F.col("degree").cast("double") * F.col("degree"))).first()[0] > PAIR_ROWS * count:
        return None
    shared = stage(lookup(edges.select("user_id", "item_id"), of_user, "user_id", ["item_id"]), "push-shared")
    others = edges.select("user_id", F.col("item_id").alias("other"))
    met = lookup(shared, others, "user_id", ["item_id"]).groupBy("item_id", "other")
    pairs = stage(met.agg(F.sum(1 / F.col("degree")).alias("weight")), "push-pairs")
    return pairs if pairs.count() <= (most if large else min(most, 2 * count)) else None


def _by_pairs(edges: DataFrame, wanted: DataFrame, pairs: DataFrame, alpha: float, tolerance: float, semantics: str, top: int | None) -> DataFrame:
    """The same on the pairs of items, which each task holds; ``held`` counts the source and the items with state (of its
    item with most of them, where each item's own scores are added)."""
    spark = edges.sparkSession
    of_item = edges.groupBy("item_id").agg(F.count(F.lit(1)).alias("degree")).toArrow()  # no more than pairs
    items, degree = (of_item.column(c).to_numpy() for c in range(2))
    order = np.argsort(items)
    items, degree = items[order], degree[order]
    table = pairs.toArrow()  # at most GRAPH_PAIRS rows
    first, other = (np.searchsorted(items, table.column(c).to_numpy()).astype(np.int32) for c in range(2))
    order = np.lexsort((other, first))
    starts = np.concatenate([[0], np.cumsum(np.bincount(first, minlength=len(items)))])
    shared = spark.sparkContext.broadcast((items, degree, starts, other[order], table.column(2).to_numpy()[order]))

    def run(batches):
        items, degree, starts, ends, weights = shared.value
        settle = lambda at, amount, own: _settled(starts, ends, weights, degree, at, amount, alpha**2, tolerance * (1 - alpha**2) / own)
        widest = float(len(items) if semantics == "reference" else degree.max())
        alone: dict[int, tuple[np.ndarray, float, int]] = {}
        for batch in batches:
            out = []
            for user, own_items in zip(batch.column(0).to_pylist(), batch.column(1)):
                at = np.searchsorted(items, np.sort(own_items.values.to_numpy()))
                own = float(len(at)) if semantics == "reference" else float(degree.max())
                if len(items) <= TASK_SOURCES:
                    for node in at.tolist():
                        if node not in alone:
                            alone[node] = settle(np.array([node]), 1.0, widest)
                    given = [alone[node] for node in at.tolist()]
                    score = sum(g[0] for g in given) * (alpha / len(at))
                    left, held = sum(g[1] for g in given) * (alpha / len(at)), max(g[2] for g in given)
                else:
                    score, left, held = settle(at, alpha / len(at), own)
                if semantics == "reference":
                    score = score * (len(at) / degree)
                found = _best(score, top)
                out.append((np.full(len(found), user), items[found], score[found], np.full(len(found), left * own / (1 - alpha**2)), np.full(len(found), held + 1)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["user_id", "item_id", "score", "bound", "held"])

    own = edges.join(wanted, "user_id", "left_semi").groupBy("user_id").agg(F.collect_list("item_id").alias("items"))
    tasks = max(8, spark.sparkContext.defaultParallelism, -(-wanted.count() // TASK_SOURCES))
    return own.repartition(tasks, "user_id").mapInArrow(run, SCORES)


def _by_rounds(edges: DataFrame, sources: DataFrame, alpha: float, tolerance: float, semantics: str, top: int | None) -> DataFrame:
    """The same with residuals in a table (source, side, node, amount); sides take turns."""
    moves = stage(transitions(edges), "push-edges")
    scale = F.col("degree") if semantics == "reference" else F.lit(moves.agg(F.max("item_degree")).first()[0])
    degrees = moves.select("user_id", F.col("user_degree").alias("degree")).distinct()
    starts = stage(sources.select("user_id").distinct().join(degrees, "user_id"), "push-sources")
    eps = (F.lit(tolerance * (1 - alpha)) / scale).alias("eps")
    state = stage(starts.select(F.col("user_id").alias("source"), eps, F.col("user_id").alias("node"), F.lit(1.0).alias("amount"), F.lit(0).alias("side")), "push-residual")
    steps = {
        0: moves.select(F.col("user_id").alias("node"), F.col("item_id").alias("to"), F.col("user_degree").alias("degree")),
        1: moves.select(F.col("item_id").alias("node"), F.col("user_id").alias("to"), F.col("item_degree").alias("degree")),
    }
    of_node = {side: stage(step.select("node", "degree").distinct(), "push-degrees") for side, step in steps.items()}
    items, side = [], 0
    idle = 0
    while idle < 2:
        sized = state.where(F.col("side") == side).join(of_node[side], "node")
        active = stage(sized.where(F.col("amount") > F.col("eps") * F.col("degree")), "push-active")
        if active.isEmpty():
            idle += 1
        else:
            idle = 0
            if side == 1:
                items.append(active.select(F.col("source").alias("user_id"), F.col("node").alias("item_id"), "amount"))
            spread = lookup(active.drop("degree"), steps[side], "node", ["source"])
            spread = spread.select("source", "eps", F.col("to").alias("node"), (F.lit(alpha) * F.col("amount") / F.col("degree")).alias("amount"), F.lit(1 - side).alias("side"))
            quiet = state.join(active.select("source", "side", "node"), ["source", "side", "node"], "left_anti").select(spread.columns)
            before = state
            state = stage(quiet.unionByName(spread).groupBy("source", "eps", "node", "side").agg(F.sum("amount").alias("amount")), "push-residual")
            unstage(before)
        side = 1 - side
    everything = state.where("side = 1").select(F.col("source").alias("user_id"), F.col("node").alias("item_id"), F.lit(0.0).alias("amount"))
    for part in items:
        everything = everything.unionByName(part)
    total = everything.groupBy("user_id", "item_id").agg(F.sum("amount").alias("score")).where("score > 0")
    left = state.join(of_node[0].withColumn("side", F.lit(0)).unionByName(of_node[1].withColumn("side", F.lit(1))), ["node", "side"])
    left = left.groupBy(F.col("source").alias("user_id")).agg((F.max(F.col("amount") / F.col("degree") / F.col("eps")) * tolerance).alias("bound"), F.count(F.lit(1)).alias("held"))
    if semantics == "reference":
        total = total.join(of_node[1].withColumnRenamed("node", "item_id"), "item_id").join(starts.withColumnRenamed("degree", "own"), "user_id")
        total = total.withColumn("score", F.col("score") * F.col("own") / F.col("degree"))
    found = total.join(left, "user_id", "left").select("user_id", "item_id", "score", F.coalesce("bound", F.lit(0.0)).alias("bound"), F.coalesce("held", F.lit(0)).cast("long").alias("held"))
    if top is None:
        return found
    best = Window.partitionBy("user_id").orderBy(F.desc(ordering(F.col("score"))), "item_id")
    return found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= top).drop("_rank")
