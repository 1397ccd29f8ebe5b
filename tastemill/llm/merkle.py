"""Operator 11: Merkle manifest of a dataset, content-addressed, with a proof for each row.

Rows are leaves, in order within their group; every run of ``FANOUT`` nodes becomes one node until
a group has one, its subroot; the subroots, in order of their groups, become the root in the same
way. The store holds a record for each inner node: its digest and its children's.

Proofs come from the store alone. A leaf request is the digits of a rank. Requests descend from the
root: the digest in hand finds its record, the digit selects a child, the other children are put
aside. Requests with a common beginning descend as one row. At the leaf the path is reversed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tastemill.llm.common import remainder
from tastemill.session import stage

FANOUT = 16
#: Characters of a digest.
WIDTH = 64
#: Rows of a table small enough to broadcast (some hundred bytes each).
FEW_ROWS = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Path segments: the selected child's place, and the digests of the others, left to right.
PATH = "array<struct<place:int,others:string>>"


class Manifest(NamedTuple):
    """``leaves``: the rows with ``group`` (a key), ``rank``, ``leaf`` and carried columns. ``groups``:
    ``group``, ``top`` (its rank), ``subroot``, ``height``. ``store`` and ``top_store``: the records
    (``digest``, ``children``) by level, from the leaves' parents on. ``root``: None without rows."""

    leaves: DataFrame
    groups: DataFrame
    store: list[DataFrame]
    top_store: list[DataFrame]
    root: str | None


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_digest(fields: dict[str, Column]) -> Column:
    """H of the fields: ``-`` for null, else the value's UTF-8 byte count, ``:`` and the value."""
    texts = [f.cast("string") for f in fields.values()]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= FEW_ROWS else table


# -- building ------------------------------------------------------------------------------------------


def ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Add ``rank`` within ``group`` by ``order`` (nulls first), and the largest group's size.

    Rows are dealt out by ranges, so a group of any size spreads over tasks; a row's rank is its place
    in its range plus the group's rows in ranges before. ``rows`` must be a table.
    """
    by = ["group", *order]
    laid = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # the upper bits of the id are the range's number, the lower ones the place in it
    laid = stage(laid.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "merkle-order")
    counts = stage(laid.groupBy("group", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")), "merkle-ranges")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("group", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("group")).alias("n"))
    largest = places.agg(F.max("n")).first()[0] or 0
    found = laid.join(small(places, counts.count()), ["group", "part"])
    return found.withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift"), largest


def raised(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """Records by level: ``group``, ``rank``, ``digest``, ``children``, ``n`` (the group's nodes at this level).

    ``nodes`` has ``group``, ``rank``, ``digest`` and ``n``; groups of one node are finished.
    """
    levels = []
    while largest > 1:
        runs = nodes.where("n > 1").groupBy("group", F.expr(f"rank div {FANOUT}").alias("parent"))
        runs = runs.agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("run"), F.first("n").alias("n"))
        children = F.transform("run", lambda c: c["digest"])
        rows = runs.select("group", F.col("parent").alias("rank"), children.alias("children"), F.ceil(F.col("n") / FANOUT).alias("n"))
        levels.append(stage(rows.withColumn("digest", digest(F.array_join("children", ""))), f"merkle-level-{len(levels) + 1}"))
        nodes = levels[-1].select("group", "rank", "digest", "n")
        largest = -(-largest // FANOUT)
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The last node of each group: ``group``, ``subroot``, ``height``."""
    alone = [nodes.where("n = 1")] + [level.where("n = 1") for level in levels]
    parts = [a.select("group", F.col("digest").alias("subroot"), F.lit(k).alias("height")) for k, a in enumerate(alone)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def store(levels: list[DataFrame]) -> list[DataFrame]:
    """Records by content: equal subtrees are one record."""
    return [level.select("digest", "children").dropDuplicates(["digest"]) for level in levels]


def build(leaves: DataFrame, order: list[str]) -> Manifest:
    """A manifest of ``leaves``: a table with ``group`` (a string key, never null), ``leaf`` (its digest),
    and the columns of ``order``, by which leaves follow one another in their group (ties by ``leaf``)."""
    found, largest = ranked(leaves, [*order, "leaf"])
    found = stage(found, "merkle-leaves")
    nodes = found.select("group", "rank", F.col("leaf").alias("digest"), "n")
    levels = raised(nodes, largest)
    groups = stage(tops(nodes, levels), "merkle-groups")
    over = groups.select(F.lit("").alias("group"), F.col("group").alias("name"), "subroot", "height")
    over, many = ranked(over, ["name"])
    over = stage(over, "merkle-tops")
    top_nodes = over.select("group", "rank", F.col("subroot").alias("digest"), "n")
    top_levels = raised(top_nodes, many)
    root = tops(top_nodes, top_levels).first()
    named = over.select(F.col("name").alias("group"), F.col("rank").alias("top"), "subroot", "height")
    return Manifest(found.drop("n"), named, store(levels), store(top_levels), root and root["subroot"])


# -- proofs --------------------------------------------------------------------------------------------


def segment(children: Column, place: Column) -> Column:
    """The selected child's place, and the other children's digests."""
    others = F.array_join(F.filter(children, lambda c, k: k != place), "")
    return F.struct(place.cast("int").alias("place"), others.alias("others"))


def descend(starts: DataFrame, records: list[DataFrame], requests: DataFrame) -> DataFrame:
    """``group``, ``rank`` (of a run of leaves), ``children`` (null for a lone leaf), ``path``, carried columns.

    ``starts``: ``group``, ``digest``, ``height``, ``path`` so far, and more; ``requests``: ``group``,
    ``rank`` of leaves. One row for each run that has a requested leaf.
    """
    more = [c for c in starts.columns if c not in ("group", "digest", "height", "path")]
    wanted = stage(requests.select("group", F.expr(f"rank div {FANOUT}").alias("rank")).distinct(), "merkle-runs")
    places = {}
    for level in range(2, len(records) + 1):
        by = wanted if level == 2 else places[level - 1]
        found = by.groupBy("group", F.expr(f"rank div {FANOUT}").alias("rank")).agg(F.collect_list(F.expr(f"rank % {FANOUT}")).alias("places"))
        places[level] = stage(found, "merkle-places")
    active = None
    for level in range(len(records), 0, -1):
        fresh = starts.where(F.col("height") == level).select("group", F.lit(0).cast("long").alias("rank"), "digest", "path", *more)
        active = fresh if active is None else active.unionByName(fresh)
        record = records[level - 1]
        active = active.join(record, "digest")
        if level > 1:
            active = active.join(places[level], ["group", "rank"]).withColumn("place", F.explode("places"))
            child = F.element_at("children", (F.col("place") + 1).cast("int"))
            path = F.concat("path", F.array(segment(F.col("children"), F.col("place"))))
            active = active.select("group", (F.col("rank") * FANOUT + F.col("place")).alias("rank"), child.alias("digest"), path.cast(PATH).alias("path"), *more)
            active = stage(active, "merkle-frontier")
    nothing = F.lit(None).cast("array<string>").alias("children")
    alone = starts.where("height = 0").select("group", F.lit(0).cast("long").alias("rank"), nothing, "path", *more)
    if active is None:
        return alone
    return active.select("group", "rank", "children", "path", *more).unionByName(alone)


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (``group``, ``rank`` of leaves, and more) with ``subroot`` and ``path``, leaf to root."""
    empty = F.array().cast(PATH)
    # the subroots are the leaves of the upper tree
    one = manifest.groups.sparkSession.range(1)
    first = one.select(F.lit("").alias("group"), F.lit(manifest.root).alias("digest"), F.lit(len(manifest.top_store)).alias("height"), empty.alias("path"))
    asked = requests.select("group").distinct().join(manifest.groups, "group").select(F.lit("").alias("group"), F.col("top").alias("rank"), F.col("group").alias("name"), "subroot", "height")
    asked = stage(asked, "merkle-asked")
    upper = joined(asked, descend(first, manifest.top_store, asked))
    starts = upper.select(F.col("name").alias("group"), F.col("subroot").alias("digest"), "height", F.reverse("path").alias("path"), "subroot")
    return joined(requests, descend(stage(starts, "merkle-starts"), manifest.store, requests))


def joined(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests with their run's last segment added, and the ``path`` reversed: from the leaf up."""
    place = F.expr(f"rank % {FANOUT}")
    last = F.when(F.col("children").isNull(), F.array().cast(PATH)).otherwise(F.array(segment(F.col("children"), place)).cast(PATH))
    rows = requests.withColumn("run", F.expr(f"rank div {FANOUT}")).join(runs.withColumnRenamed("rank", "run"), ["group", "run"])
    return rows.withColumn("path", F.concat(last, F.reverse("path"))).drop("children", "run")


def siblings_digest(path: str = "path") -> Column:
    """H of the siblings, level by level from the leaf, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: s["others"]), ""))


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its path lead to."""

    def up(below: Column, s: Column) -> Column:
        cut = s["place"] * WIDTH
        return digest(F.concat(F.substring(s["others"], F.lit(1), cut), below, F.substring(s["others"], cut + 1, F.length(s["others"]))))

    return F.aggregate(path, leaf, up)


# -- documents -----------------------------------------------------------------------------------------


def documents_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of the documents by source, and ``changed``: the leaf of a tampered row (else null).

    Tampering lower-cases A-Z of the text where 5 divides the id's crc32. Groups are keyed such that a
    null source comes first and others follow bytewise.
    """
    fields = {c: F.col(c) for c in FIELDS}
    lowered = {**fields, "text": F.translate("text", UPPER, DOWN)}
    changed = F.when(remainder("doc_id", 5) == 0, leaf_digest(lowered))
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select("doc_id", group.alias("group"), leaf_digest(fields).alias("leaf"), changed.alias("changed"))


def verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified`` of each row.

    Null fields count as ``-``, empty texts as ``0:``. A null id comes first in its source and is never
    tampered; rows of one id follow by their leaf, so equal rows have each a leaf and proof of its own.
    Texts of any length are hashed where they are read. No rows give no rows. Only the columns of
    ``FIELDS`` are read; others may have any name.
    """
    manifest = build(stage(documents_leaves(docs), "merkle-digests"), ["doc_id"])
    proofs = prove(manifest, manifest.leaves)
    root = F.lit(manifest.root).cast("string")
    rows = proofs.select("doc_id", "leaf", "subroot", root.alias("root"), siblings_digest().alias("proof_sha256"), folded(F.coalesce("changed", "leaf")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
