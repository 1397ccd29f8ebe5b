"""Operator 8: balanced label propagation puts documents into shards.

Linked documents (members of a group, here equal texts) move towards the shard that holds most of
their group, round by round, under quotas that keep the shards' sizes near even. Each round is one
aggregation by group and one join; moves between two shards are let through up to the smaller of
the two demands plus the free room, whole groups first. A last cut of the order by shard makes the
numbers of rows exact, which moves rows only at the borders between shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window

from tastemill.session import stage, unstage

ROUNDS = 4
#: Shards may be this much larger than the mean while labels spread.
SLACK = 0.02
#: Moves are let through in bins of groups, so that a quota needs no order of the rows.
BINS = 1024
#: Rows of one bin of the last order; a larger group is dealt over several bins.
BIN_ROWS = 20_000
#: The last order has at most about this many bins, whose counts go through the driver.
MOST_BINS = 100_000
#: Groups of more than this share of a shard move in parts.
PART = 0.02


def quotas(demand: dict[tuple[int, int], int], load: list[int], capacity: float) -> dict[tuple[int, int], int]:
    """How many rows may move from one shard to another: exchanges, then what the room allows."""
    allowed = {(a, b): min(n, demand.get((b, a), 0)) for (a, b), n in demand.items()}
    room = [max(0, int(capacity) - n) for n in load]
    for a, b in sorted(demand, key=lambda p: (-load[p[0]], p)):
        more = min(demand[a, b] - allowed[a, b], room[b])
        allowed[a, b] += more
        room[b] -= more
        room[a] += more
    return allowed


def _lookup(values: dict[int, int], key: Column, default: int) -> Column:
    if not values:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key), F.lit(default))


def propagate(linked: DataFrame, alone: list[int], shards: int, rounds: int = ROUNDS) -> DataFrame:
    """Spread the labels of ``linked`` (row columns, ``hub``, ``members``, ``shard``).

    ``alone`` holds the rows without links in each shard, which stay where they are.
    """
    state = linked
    for turn in range(rounds):
        cells = state.groupBy("hub", "shard").agg(F.count("*").alias("n"))
        tie = F.xxhash64("hub", "shard", F.lit(turn))
        best = cells.groupBy("hub").agg(F.max_by("shard", F.struct("n", tie)).alias("target"), F.count("*").alias("places"))
        best = best.where("places > 1").drop("places")
        load = dict(state.groupBy("shard").agg(F.count("*")).collect())  # a row for each shard
        load = [alone[s] + load.get(s, 0) for s in range(shards)]
        capacity = sum(load) / shards * (1 + SLACK)
        in_parts = F.col("members") > PART * capacity
        key = F.when(in_parts, F.xxhash64("doc_id", "hub", F.lit(turn))).otherwise(F.xxhash64("hub", F.lit(turn)))
        wanted = state.join(best, "hub", "left").withColumn("target", F.coalesce("target", "shard"))
        wanted = stage(wanted.withColumn("bin", F.pmod(key, F.lit(BINS)).cast("int")), "shard-moves")
        flows = wanted.where("target <> shard").groupBy("shard", "target", "bin").agg(F.count("*").alias("n")).collect()  # shards^2 x BINS at most
        demand: dict[tuple[int, int], int] = {}
        for r in flows:
            demand[r["shard"], r["target"]] = demand.get((r["shard"], r["target"]), 0) + r["n"]
        left, upto = quotas(demand, load, capacity), {}
        for r in sorted(flows, key=lambda r: (r["shard"], r["target"], r["bin"])):
            pair = r["shard"], r["target"]
            if left[pair] >= r["n"] and upto.get(pair, 0) >= 0:
                left[pair] -= r["n"]
                upto[pair] = r["bin"] + 1
            else:
                left[pair] = -1  # bins after the first that does not fit wait for the next round
        limit = _lookup({a * shards + b: n for (a, b), n in upto.items()}, F.col("shard") * shards + F.col("target"), 0)
        moved = F.when(F.col("bin") < limit, F.col("target")).otherwise(F.col("shard"))
        after = stage(wanted.withColumn("shard", moved).drop("target", "bin"), "shard-labels")
        if turn:
            unstage(state)
        unstage(wanted)
        state = after
        if not upto:
            break
    return state


def assign(rows: DataFrame, shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows (``doc_id``, ``hub`` and others).

    Shards differ by at most one row; slots count from 0 without gaps. Rows of one hub are linked;
    a null hub links nothing. Equal rows are interchangeable and null ids are allowed. No rows give
    no rows. Joins and sums are by hub after a sum in each task, so a hot hub is 8 rows there; in
    the join of rows with their hub's target adaptive execution splits it.
    """
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "hub"), F.lit(shards)).cast("int"))
    rows = stage(rows, "shard-rows")
    sizes = rows.where("hub IS NOT NULL").groupBy("hub").agg(F.count("*").alias("members")).where("members > 1")
    joined = stage(rows.join(sizes, "hub", "left").withColumn("members", F.coalesce("members", F.lit(1))), "shard-members")
    linked, single = joined.where("members > 1"), joined.where("members = 1")
    alone = dict(single.groupBy("shard").agg(F.count("*")).collect())
    labelled = propagate(linked, [alone.get(s, 0) for s in range(shards)], shards, rounds)
    both = single.unionByName(labelled.select(*single.columns))

    total = joined.count()
    per_bin = max(BIN_ROWS, total // MOST_BINS)
    parts = max(1, -(-total // (shards * per_bin)))
    text_bin = F.pmod(F.xxhash64(F.coalesce(F.col("hub"), F.col("doc_id").cast("string"))), F.lit(parts)).cast("int")
    own = F.ceil(F.col("members") / per_bin).cast("int")
    placed = both.withColumn("_text", text_bin).withColumn("_part", F.pmod(F.xxhash64("doc_id", F.lit(1)), own).cast("int"))
    bins = ["shard", "_text", "_part"]
    counts = sorted(tuple(r) for r in placed.groupBy(*bins).agg(F.count("*").alias("n")).collect())
    offsets, at = [], 0
    for *key, n in counts:
        offsets.append((*key, at))
        at += n
    spark = rows.sparkSession
    first = spark.createDataFrame(offsets, "shard int, _text int, _part int, _first long")
    others = [F.col(f"`{c}`") for c in rows.columns if c not in ("hub", "doc_id", "shard")]
    order = Window.partitionBy(*bins).orderBy("hub", "doc_id", *others)
    place = F.col("_first") + F.row_number().over(order) - 1
    placed = placed.join(F.broadcast(first), bins).withColumn("_place", place)
    # shard s has the places from ceil(s * total / shards) on
    exact = F.expr(f"CAST(_place * {shards} DIV {max(1, total)} AS INT)")
    begin = F.expr(f"(shard * {total}L + {shards - 1}L) DIV {shards}L")
    return placed.withColumn("shard", exact).withColumn("slot", F.col("_place") - begin).drop("members", "_text", "_part", "_first", "_place")


def by_text(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Shards of documents whose links are equal texts; null and empty texts are one group."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.octet_length(value) + 1).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        F.sha2(value.cast("binary"), 256).alias("hub"),
    )
    return assign(rows, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
