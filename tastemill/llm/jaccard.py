"""Operator 9: n-gram Jaccard join with a count-vector R-tree.

A text's shingles are hashed into groups; the counts per group are a point. The overlap of two sets
is at most the sum of the smaller coordinates, so an R-tree over the points finds for each set those
that can reach the threshold, and the shingles themselves confirm what is left.

Sets that meet at all share one of their first shingles in a common order (shingles of many
documents come last), so Spark deals the points out by those. Equal sets are one point throughout.
"""

from __future__ import annotations

import hashlib
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tastemill.llm.common import LOWER, WHITE, map_texts, mix, raw, run_hashes, window_hashes, words
from tastemill.llm.filters import build, contains
from tastemill.llm.links import components
from tastemill.session import stage, unstage


class Rule(NamedTuple):
    """Shingles of ``size`` words; sets link when part * |A and B| >= whole * |A or B|."""

    size: int
    part: int
    whole: int


#: The operator's own rule, and that of near-duplicate stages.
JOIN, NEAR = Rule(3, 100, 90), Rule(5, 100, 80)
#: Coordinates of a point: a power of two that leaves at most ``PER_GROUP`` shingles of an average set
#: in a group, from ``GROUPS`` on. Few groups cannot tell long sets apart: counts of very many
#: shingles are alike whatever the shingles are.
GROUPS, PER_GROUP = 64, 8
#: Documents of the sample that tells frequent shingles, least documents of such a shingle, most of them.
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 2000, 4, 200_000
#: Points with one key that one task takes; more are dealt out as pairs of blocks.
TOGETHER = 8192
#: Points of a group that are compared directly, without a tree.
FEW = 24
LEAF = 32


# -- sets ------------------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = JOIN.size) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, as hashes in order, and their offsets."""
    rows = len(offsets) - 1
    data = LOWER[data]
    starts, ends, first = words(data, offsets, ~WHITE[data])
    hashed = run_hashes(data, starts, ends)
    counts = np.diff(first)
    row = np.repeat(np.arange(rows), counts)
    whole = window_hashes(hashed, size)
    at = np.flatnonzero(row[: len(whole)] == row[size - 1 :]) if len(whole) else np.zeros(0, np.int64)
    value, owner = [whole[at]], [row[at]]
    for k in range(1, size):  # fewer words: the whole sequence is one shingle
        short = np.flatnonzero(counts == k)
        code = np.full(len(short), k, np.uint64)
        for j in range(k):
            code = mix(code * np.uint64(31) + hashed[first[short] + j])
        value.append(code)
        owner.append(short)
    value, owner = np.concatenate(value), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(rows + 1))


def points(value: np.ndarray, offsets: np.ndarray, width: int = GROUPS) -> np.ndarray:
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    return np.bincount(owner * width + (value % np.uint64(width)).astype(np.int64), minlength=rows * width).reshape(rows, width).astype(np.int32)


def bands(sizes: np.ndarray, rule: Rule = JOIN) -> np.ndarray:
    """Band of each size; bounds grow by the largest ratio of sizes that sets which link can have."""
    return np.ceil(np.log(np.maximum(sizes, 1)) / np.log(rule.part / rule.whole) + 1e-9).astype(np.int64)


def resolutions(band: np.ndarray, rule: Rule = JOIN) -> np.ndarray:
    """Coordinates of the points that meet in a band, from the largest size in it."""
    largest = (rule.part / rule.whole) ** band.astype(float)
    return np.maximum(GROUPS, 2 ** np.ceil(np.log2(np.maximum(largest / PER_GROUP, 1))).astype(np.int64))


def banded_points(value: np.ndarray, offsets: np.ndarray, band: np.ndarray, rule: Rule = JOIN, but: np.ndarray | None = None) -> list[bytes]:
    """Each set's packed point at the resolution of its band; empty where that is the one in ``but``."""
    wide = resolutions(band, rule)
    if but is not None:
        wide = np.where(wide == but, 0, wide)
    out: list[bytes] = [b""] * len(band)
    for width in np.unique(wide[wide > 0]).tolist():
        at = np.flatnonzero(wide == width)
        sizes = offsets[at + 1] - offsets[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        held = value[np.repeat(offsets[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        step = max(1, (1 << 22) // width)  # bounded memory for very wide points
        for a in range(0, len(at), step):
            b = min(a + step, len(at))
            for k, blob in zip(at[a:b], packed(points(held[ends[a] : ends[b]], ends[a : b + 1] - ends[a], width))):
                out[k] = blob
    return out


def packed(counts: np.ndarray) -> list[bytes]:
    """Points in as few bytes as their counts need: one, two or four for each coordinate, after their number."""
    kinds = [np.uint8 if p.max() < 1 << 8 else np.uint16 if p.max() < 1 << 16 else np.int32 for p in counts]
    return [bytes([np.dtype(kind).itemsize]) + p.astype(kind).tobytes() for kind, p in zip(kinds, counts)]


def widths(blobs: list[bytes]) -> np.ndarray:
    return np.array([(len(b) - 1) // b[0] for b in blobs], np.int64)


def unpacked(blobs: list[bytes]) -> np.ndarray:
    """Points of one width."""
    width = int(widths(blobs[:1])[0]) if blobs else GROUPS
    out = np.zeros((len(blobs), width), np.int32)
    sizes = np.array([b[0] for b in blobs])
    for size, kind in ((1, np.uint8), (2, np.uint16), (4, np.int32)):
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join(blobs[k][1:] for k in at), kind).reshape(-1, width)
    return out


def meeting_keys(first: np.ndarray, ends: np.ndarray, sizes: np.ndarray, rule: Rule = JOIN) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which sets that can link meet: a first shingle and a band of sizes.

    A set goes to its own band and to the next, in turn, so two sets whose sizes allow a link share a
    band.
    """
    own = np.repeat(bands(sizes, rule).astype(np.uint64), np.diff(ends))
    both = np.stack([mix(first ^ mix(own)), mix(first ^ mix(own + np.uint64(1)))], axis=1)
    return both.ravel(), 2 * ends


def firsts(value: np.ndarray, offsets: np.ndarray, frequent: np.ndarray, rule: Rule = JOIN) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set, of which two sets that link share one; and their offsets."""
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    late = np.zeros(len(value), bool)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)] == value
    order = np.lexsort((value, late, owner))
    take = sizes - -(-rule.whole * sizes // rule.part) + 1
    take[sizes == 0] = 0
    rank = np.arange(len(value)) - np.repeat(offsets[:-1], sizes)
    keep = rank < np.repeat(take, sizes)
    return value[order][keep], np.concatenate([[0], np.cumsum(take)])


def frequent_shingles(docs: DataFrame, text: str, rows: int = SAMPLE_DOCS, rule: Rule = JOIN) -> np.ndarray:
    """Shingles of several documents of a sample; they only set the order, not the result."""
    named = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.col(f"`{text}`").alias("text"))
    chosen = stage(named.select("h").distinct().orderBy("h").limit(rows), "jaccard-sample")

    def work():
        def step(batch):
            value, offsets = shingle_sets(*raw(batch.column("text")), rule.size)
            return {"shingles": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value.astype(np.int64)))}

        return step

    sets = map_texts(named.join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"]), work, "shingles array<long>", "text", [])
    counts = sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["s"] for r in found], np.int64).astype(np.uint64))


def signatures(docs: DataFrame, text: str = "text", carry: list[str] | None = None, rule: Rule = JOIN) -> DataFrame:
    """Add ``n_shingles``, ``key`` (digest of the set; null if it is empty), ``firsts`` (the first
    shingles) and ``points``: at the resolution of the set's band, and of the next if that differs."""
    frequent = frequent_shingles(docs, text, rule=rule)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT

    def work():
        def step(batch):
            value, offsets = shingle_sets(*raw(batch.column(text)), rule.size)
            band = bands(np.diff(offsets), rule)
            both = zip(banded_points(value, offsets, band, rule), banded_points(value, offsets, band + 1, rule, resolutions(band, rule)))
            first, ends = firsts(value, offsets, shared.value, rule)
            cut = offsets.tolist()
            blob = value.tobytes()
            keys = [hashlib.md5(blob[8 * a : 8 * b]).digest() if b > a else None for a, b in zip(cut, cut[1:])]
            return {
                "n_shingles": np.diff(offsets),
                "key": pa.array(keys, pa.binary()),
                "points": pa.array([[a, b] if b else [a] for a, b in both], pa.list_(pa.binary())),
                "firsts": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(first.astype(np.int64))),
            }

        return step

    return map_texts(docs, work, "n_shingles long, key binary, points array<binary>, firsts array<long>", text, carry)


# -- the tree ----------------------------------------------------------------------------------------


def reaches(overlap, total, rule: Rule = JOIN):
    """Can two sets of together ``total`` shingles link with this overlap?"""
    return (rule.part + rule.whole) * overlap >= rule.whole * total


class RTree:
    """Points in leaves by size and coordinates; each node holds its largest coordinates and sizes."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, rule: Rule = JOIN):
        self.counts, self.sizes, self.rule = counts, sizes, rule
        self.order = self._pack(np.arange(len(sizes)))
        high, low, top = counts[self.order], sizes[self.order], sizes[self.order]
        self.levels = []
        while len(high) > 1:
            at = np.arange(0, len(high), LEAF)
            high, low, top = np.maximum.reduceat(high, at), np.minimum.reduceat(low, at), np.maximum.reduceat(top, at)
            self.levels.append((high, low, top))

    def _pack(self, rows: np.ndarray) -> np.ndarray:
        """Order of the rows such that neighbours are alike: halves by the widest coordinate."""
        out, work = [], [rows]
        while work:
            part = work.pop()
            if len(part) <= LEAF:
                out.append(part)
                continue
            own = np.column_stack([self.sizes[part], self.counts[part]])
            wide = np.argmax(own.max(axis=0) - own.min(axis=0))
            order = part[np.argsort(own[:, wide], kind="stable")]
            half = -(-len(order) // 2 // LEAF) * LEAF or LEAF
            work += [order[half:], order[:half]]
        return np.concatenate(out)

    def near(self, point: np.ndarray, size: int, live: np.ndarray) -> np.ndarray:
        """Live points whose bound on the overlap lets them link with the given one."""
        at, rule = None, self.rule
        for high, low, top in reversed(self.levels):
            at = np.arange(len(high)) if at is None else (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < len(high)]
            at = at[(rule.part * top[at] >= rule.whole * size) & (rule.whole * low[at] <= rule.part * size)]
            at = at[reaches(np.minimum(high[at], point).sum(axis=1), low[at] + size, rule)]
        at = np.arange(len(self.order)) if at is None else (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        rows = self.order[at[at < len(self.order)]]
        rows = rows[live[rows]]
        return rows[reaches(np.minimum(self.counts[rows], point).sum(axis=1), self.sizes[rows] + size, rule)]


def spanning(counts: np.ndarray, sizes: np.ndarray, verify=None, rule: Rule = JOIN) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold each component together: one for each point that a search reaches.

    Each point is found once and then leaves the search, so a clique of n points gives n - 1 links
    and not all pairs. Without ``verify`` a bound that suffices counts as a link.
    """
    n = len(sizes)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tree, live = RTree(counts, sizes, rule), np.ones(n, bool)
    left, right = [], []
    for seed in range(n):
        if not live[seed]:
            continue
        live[seed] = False
        queue = [seed]
        while queue:
            own = queue.pop()
            found = tree.near(counts[own], sizes[own], live)
            if verify is not None and len(found):
                found = found[verify(own, found)]
            live[found] = False
            left += [own] * len(found)
            right += found.tolist()
            queue += found.tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


# -- dealing out -----------------------------------------------------------------------------------------


def _groups(rows: DataFrame, group: str) -> DataFrame:
    """Groups of two rows or more, with their numbers of rows."""
    return stage(rows.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1"), "jaccard-groups")


def _tokens(distinct: DataFrame, rule: Rule) -> DataFrame:
    """``key``, ``token``, ``next``: the meeting keys of each set; is it that of the next band?"""

    def run(batches):
        for batch in batches:
            column = batch.column("firsts")
            ends = column.offsets.to_numpy().astype(np.int64)
            first = column.values.to_numpy().view(np.uint64)[ends[0] : ends[-1]]
            tokens, cut = meeting_keys(first, ends - ends[0], batch.column("n_shingles").to_numpy(), rule)
            at = np.repeat(np.arange(batch.num_rows), np.diff(cut))
            step = 1 << 17
            for a in range(0, len(tokens), step):
                part = slice(a, a + step)
                both = np.arange(a, min(a + step, len(tokens))) % 2 == 1
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at[part])), pa.array(tokens[part].view(np.int64)), pa.array(both)], names=["key", "token", "next"])

    return distinct.select("key", "n_shingles", "firsts").mapInArrow(run, "key binary, token long, next boolean")


def _meetings(dealt: DataFrame) -> DataFrame:
    """Tokens of two sets or more, with their numbers of sets; one token of those with the same sets.

    Near copies share very many first shingles, and meet once under all of them. Most tokens are of one
    set; these are only counted.
    """
    shared = _groups(dealt, "token")
    marks = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"_x{k}") for k in (0, 1)]
    found = _kept(dealt.select("token", "key"), "token", shared).groupBy("token").agg(F.count("*").alias("_n"), *marks).where("_n > 1")
    return stage(found.groupBy("_n", "_x0", "_x1").agg(F.min("token").alias("token")).select("token", "_n"), "jaccard-groups")


def _kept(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose long ``column`` may be among ``values``; a filter of bounded size tells the others.

    Few rows that the exact join would drop go on to it, so what is shuffled follows the result.
    """
    shared = rows.sparkSession.sparkContext.broadcast(build(values, column, values.count()))

    def some(batches):
        for batch in batches:
            held = batch.column(column)
            wanted = contains(shared.value, pc.fill_null(held, 0).to_numpy()) & held.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(wanted))

    return rows.mapInArrow(some, rows.schema)


def _blocks(rows: DataFrame, group: str, sizes: DataFrame, limit: int) -> DataFrame:
    """Add ``cell``: groups of more than ``limit`` rows go out as all pairs of their blocks.

    A row of a group with b blocks appears in b cells, so every two rows of a group share a cell.
    """
    rows = rows.join(sizes, group)
    blocks = F.ceil(F.col("_n") / limit).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    both = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j))
    return rows.withColumn("cell", F.explode(both)).drop("_n")


def _by_group(rows: DataFrame, names: list[str], work, schema: str) -> DataFrame:
    """Run ``work`` on runs of whole groups: rows are dealt out and sorted by ``names``."""

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array([mix(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) * np.uint64(2 * k + 1) for k, c in enumerate(names)]).sum(axis=0, dtype=np.uint64)
            change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if waiting and keys[0] != last:
                yield from work(pa.Table.from_batches(waiting), names)
                waiting = []
            cut = int(change[-1]) if len(change) else 0
            if cut:
                yield from work(pa.Table.from_batches([*waiting, batch.slice(0, cut)]), names)
                waiting = []
            waiting.append(batch.slice(cut))
            last = keys[-1]
        if waiting:
            yield from work(pa.Table.from_batches(waiting), names)

    dealt = rows.repartition(*(F.col(n) for n in names)).sortWithinPartitions(*names)
    return dealt.mapInArrow(run, schema)


def _bounds(table: pa.Table, names: list[str]) -> np.ndarray:
    own = np.column_stack([table.column(n).to_numpy().astype(np.int64) for n in names])
    change = np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1
    return np.concatenate([[0], change, [len(own)]])


def _edges(keys: list, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    a, b = [keys[k] for k in left], [keys[k] for k in right]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _candidate_links(table: pa.Table, names: list[str], rule: Rule):
    """Links by the bound alone: all pairs of small groups, spanning links of larger ones."""
    cut = _bounds(table, names)
    keys = table.column("key").to_pylist()
    blobs = table.column("point").to_pylist()
    sizes = table.column("n_shingles").to_numpy()
    wide = widths(blobs)
    group = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    many = np.diff(cut)
    small = many[group] <= FEW
    for width in np.unique(wide[small]).tolist():  # sets that meet have points of one width
        rows = np.flatnonzero(small & (wide == width))
        for a, b in _runs(group[rows], max(1 << 12, (1 << 23) // width)):
            own = rows[a:b]
            counts = unpacked([blobs[k] for k in own])
            for left, right in _close_pairs(counts, sizes[own], group[own], rule):
                yield _edges(keys, own[left], own[right])
    for g in np.flatnonzero(many > FEW).tolist():
        rows = slice(int(cut[g]), int(cut[g + 1]))
        left, right = spanning(unpacked(blobs[rows]), sizes[rows], rule=rule)
        if len(left):
            yield _edges(keys[rows], left, right)


def _runs(group: np.ndarray, limit: int):
    """Slices of about ``limit`` rows that divide no group."""
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    cuts = [0] if len(group) else []
    for b in begins.tolist():
        if b - cuts[-1] >= limit:
            cuts.append(b)
    return zip(cuts, [*cuts[1:], len(group)])


def _close_pairs(counts: np.ndarray, sizes: np.ndarray, group: np.ndarray, rule: Rule):
    """Pairs of rows of a group that the bound lets link; groups have at most ``FEW`` rows, in a row."""
    piece = max(1, (1 << 21) // counts.shape[1])
    for step in range(1, FEW):
        at = np.flatnonzero(group[step:] == group[:-step])
        left, right = at, at + step
        good = reaches(np.minimum(sizes[left], sizes[right]), sizes[left] + sizes[right], rule)
        left, right = left[good], right[good]
        for a in range(0, len(left), piece):
            x, y = left[a : a + piece], right[a : a + piece]
            good = reaches(np.minimum(counts[x], counts[y]).sum(axis=1), sizes[x] + sizes[y], rule)
            if good.any():
                yield x[good], y[good]


def _verified_links(table: pa.Table, names: list[str], rule: Rule):
    """Spanning links by the shingles themselves."""
    cut = _bounds(table, names)
    column = table.column("shingles").combine_chunks()
    value, offsets = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy().astype(np.int64)
    keys = table.column("key").to_pylist()
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        sets = [value[offsets[r] : offsets[r + 1]] for r in range(a, b)]
        flat, ends = value[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        sizes = np.diff(ends)

        def verify(own, found):
            mine = sets[own]
            out = np.zeros(len(found), bool)
            for k, other in enumerate(found.tolist()):
                theirs = sets[other]
                place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                same = int(np.count_nonzero(mine[place] == theirs))
                out[k] = rule.part * same >= rule.whole * (len(mine) + len(theirs) - same)
            return out

        left, right = spanning(points(flat, ends, int(resolutions(bands(sizes.max(keepdims=True), rule), rule)[0])), sizes, verify, rule)
        if len(left):
            yield _edges(keys[a:b], left, right)


# -- the join ----------------------------------------------------------------------------------------------


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", together: int = TOGETHER, carry: list[str] | None = None, rule: Rule = JOIN) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links) of each document.

    Texts without words, and null texts, have an empty set and stand alone. Documents with equal
    sets are one class. Rows that repeat an id are joined only if their texts are. A null id is
    never the smallest; a component of null ids only has a null id. No rows give no rows. Columns
    to carry must not be named like those of the result.
    """
    carry = carry or []
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), *carry)
    signed = stage(signatures(docs, carry=["doc_id", *carry], rule=rule), "jaccard-sets")
    rows = signed.where("key IS NOT NULL")
    one = (F.first(c).alias(c) for c in ("n_shingles", "points", "firsts"))
    distinct = stage(rows.groupBy("key").agg(F.min("doc_id").alias("least"), *one), "jaccard-distinct")

    tokens = _tokens(distinct, rule)
    shared = _meetings(tokens)
    dealt = _blocks(_kept(tokens, "token", shared), "token", shared, together).join(distinct.select("key", "n_shingles", "points"), "key")
    dealt = dealt.withColumn("point", F.when(F.col("next"), F.element_at("points", -1)).otherwise(F.element_at("points", 1)))
    rough = components(_by_group(dealt.select("token", "cell", "key", "n_shingles", "point"), ["token", "cell"], partial(_candidate_links, rule=rule), "a binary, b binary"))

    # the shingles of the sets in a rough component, from one text of each
    rough = rough.select(F.col("node").alias("key"), F.conv(F.substring(F.hex("root"), 1, 15), 16, 10).cast("long").alias("cluster"))
    wanted = stage(rough.join(distinct.select("key", "least"), "key"), "jaccard-wanted")
    sets = stage(_sets_of(docs.select("doc_id", "text"), wanted, rule), "jaccard-cluster-sets")
    cells = _blocks(sets, "cluster", _groups(sets, "cluster"), max(1, together // 4))
    linked = components(_by_group(cells.select("cluster", "cell", "key", "shingles"), ["cluster", "cell"], partial(_verified_links, rule=rule), "a binary, b binary"))

    rooted = stage(distinct.select("key", "least").join(linked.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "jaccard-roots")
    for done in (distinct, shared, wanted, sets):
        unstage(done)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("key", "component_id")
    alone = signed.where("key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *carry)
    return rows.join(named, "key").select("doc_id", "n_shingles", "component_id", *carry).unionByName(alone)


def _sets_of(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """``key``, ``cluster``, ``shingles`` of each wanted set, from one document that has it.

    The document with the set's smallest id has it; as an id may also stand at another text, the
    texts found are signed again. Sets of documents without ids are found among those by their key.
    """

    def work():
        def step(batch):
            value, offsets = shingle_sets(*raw(batch.column("text")), rule.size)
            cut, blob = offsets.tolist(), value.tobytes()
            return {
                "own": pa.array([hashlib.md5(blob[8 * a : 8 * b]).digest() for a, b in zip(cut, cut[1:])], pa.binary()),
                "shingles": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value.astype(np.int64))),
            }

        return step

    schema = "own binary, shingles array<long>"
    ids = wanted.where("least IS NOT NULL").withColumnRenamed("least", "doc_id")
    found = _kept(docs, "doc_id", ids).join(ids, "doc_id").select("key", "cluster", "text")
    named = map_texts(found, work, schema, "text", ["key", "cluster"]).where("own = key").drop("own")
    nameless = map_texts(docs.where("doc_id IS NULL"), work, schema, "text", [])
    nameless = nameless.withColumnRenamed("own", "key").join(wanted.where("least IS NULL").select("key", "cluster"), "key")
    return named.unionByName(nameless.select("key", "cluster", "shingles")).dropDuplicates(["key"])


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rule: Rule = JOIN) -> DataFrame:
    """The documents (all their columns), one of each component: that with the smallest id.

    Equal rows count as one. Documents without an id that are linked to none with one all stay,
    but for equal texts. Empty texts stand alone.
    """
    digest = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)
    rows = docs.withColumn("_digest", digest)
    found = stage(classes(rows, text, doc_id, carry=["_digest"], rule=rule), "jaccard-classes")
    chosen = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.col("_digest").alias("_chosen")).distinct()
    chosen = stage(chosen, "jaccard-chosen")
    kept = rows.join(chosen, rows[doc_id].eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_chosen")), "left_semi")
    repeated = found.groupBy("doc_id", "_digest").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():  # equal rows; without any, one pass over the texts is saved
        kept = kept.dropDuplicates([doc_id, "_digest"])
    return kept.drop("_digest")
