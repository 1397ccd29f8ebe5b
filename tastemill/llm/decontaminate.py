"""Operator 5: benchmark decontamination by Wu-Manber search for many word windows at once.

Texts are normalised to lower-case words with one space around each, so that a window of words is
a byte string. A shift table over hashed blocks of bytes skips positions where no window can end;
where the shift is 0, the hash of the window's first bytes (its suffix block) selects a bucket of
test strings, and their bytes are compared with the text. All texts of a batch advance together:
each step moves thousands of cursors with a few numpy operations.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tastemill.llm.common import LOWER, map_texts, raw, row_sums, words
from tastemill.session import stage

WINDOW = 13
#: The benchmark is searched in blocks of at most about this many bytes of text, a pass for each.
BLOCK_BYTES = 16 << 20
#: Bits of the shift table's index.
TABLE_BITS = 18
#: Bytes of text that one cursor walks over.
STRIDE = 2048

#: Bytes of words: digits, lower-case letters and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows as `` w1 w2 ... wn `` (a space before each word, two at each row's end).

    Returns the bytes, the place of the space before each word, and each row's first word.
    """
    data = LOWER[data]
    inside = WORD[data]
    starts, ends, first = words(data, offsets, inside)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    places = np.concatenate([[0], np.cumsum(ends - starts + 1)])[:-1] + 2 * row
    size = int((ends - starts).sum()) + len(starts) + 2 * len(counts)
    out = np.full(size, 0x20, np.uint8)
    at = np.repeat(places + 1 - starts, ends - starts) + np.flatnonzero(inside)
    out[at] = data[inside]
    return out, places, first


def block_hash(data: np.ndarray, at: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of the ``size`` (at most 8) bytes that start at each place."""
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        value = value << np.uint64(8) | data[at + k]
    value = (value + np.uint64(salt)) * _MULTIPLY
    return value ^ (value >> np.uint64(29))


class Tables:
    """Shift table and suffix buckets of the patterns whose lengths lie within one octave."""

    def __init__(self, patterns: list[tuple[bytes, int, list[int]]]):
        self.patterns = patterns
        self.least = m = min(len(p) for p, _, _ in patterns)
        self.block = b = min(8, max(2, m // 3))
        heads = np.frombuffer(b"".join(p[:m] for p, _, _ in patterns), np.uint8)
        self.mask = (1 << TABLE_BITS) - 1
        self.shift = np.full(1 << TABLE_BITS, m - b + 1, np.int32)
        base = np.arange(len(patterns)) * m
        for k in range(m - b + 1):
            slot = (block_hash(heads, base + k, b) & np.uint64(self.mask)).astype(np.int64)
            np.minimum.at(self.shift, slot, m - b - k)
        self.order = np.argsort(slot, kind="stable")
        self.bucket = np.searchsorted(slot[self.order], np.arange(len(self.shift) + 1))
        self.head = min(8, m)
        self.prefix = block_hash(heads, base, self.head, 1)

    def search(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and pattern numbers of all occurrences."""
        m, b, last = self.least, self.block, len(data) - self.least
        if last < 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(0, last + 1, STRIDE)
        stop = np.minimum(at + STRIDE, last + 1)
        found = []
        while len(at):
            slot = (block_hash(data, at + (m - b), b) & np.uint64(self.mask)).astype(np.int64)
            skip = self.shift[slot]
            zero = skip == 0
            if zero.any():
                found.append((at[zero], slot[zero]))
            at = at + np.maximum(skip, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, slot = (np.concatenate(x) for x in zip(*found))
        low, many = self.bucket[slot], self.bucket[slot + 1] - self.bucket[slot]
        total = int(many.sum())
        each = np.repeat(np.arange(len(at)), many)
        member = self.order[np.arange(total) - np.repeat(np.cumsum(many) - many, many) + low[each]]
        place = at[each]
        same = block_hash(data, place, self.head, 1) == self.prefix[member]
        place, member = place[same], member[same]
        text = data.tobytes()
        keep = [text.startswith(self.patterns[k][0], p) for p, k in zip(place.tolist(), member.tolist())]
        return place[keep], member[keep]


def windows(items: list[tuple[object, str]], size: int = WINDOW) -> list[tuple[bytes, int, list[int]]]:
    """Distinct windows: bytes with the spaces around, number of words, places of the items."""
    data, offsets = raw(pa.array([t for _, t in items], pa.string()))
    text, places, first = normalise(data, offsets)
    text, out = text.tobytes(), {}
    for k in range(len(items)):
        a, b = int(first[k]), int(first[k + 1])
        for w in range(a, max(a, b - size) + 1 if b > a else a):
            end = min(w + size, b)
            stop = int(places[end]) + 1 if end < b else text.index(b" ", int(places[b - 1]) + 1) + 1
            _, own = out.setdefault(text[int(places[w]) : stop], (end - w, set()))
            own.add(k)
    return [(p, n, sorted(own)) for p, (n, own) in out.items()]


def build(items: list[tuple[object, str]], size: int = WINDOW) -> list[Tables]:
    octaves: dict[int, list] = {}
    for p in windows(items, size):
        octaves.setdefault(len(p[0]).bit_length(), []).append(p)
    return [Tables(p) for _, p in sorted(octaves.items())]


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    carry: list[str] | None = None,
) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``items`` (sorted ids as strings) and ``spans`` to each document.

    ``spans`` is binary: little-endian signed 64-bit pairs (first word, word after the last) of the
    maximal runs of hit words. Null texts have no words; items without words match nothing; items
    with the same id count once, and null ids are left out of ``items`` though their words are hit.
    An empty benchmark hits nothing, an empty table stays empty.

    The benchmark is the stated query set: it is read in blocks of bounded size. Each block is one
    pass over the rows; what a pass finds is merged with the row's earlier finds.
    """
    total = benchmark.agg(F.sum(F.octet_length(F.col(f"`{item_text}`")))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    wanted = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t"))
    wanted = wanted.where("t IS NOT NULL").distinct()
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("n_words", "n_hit", "items", "spans")]
    keep = list(dict.fromkeys([*carry, text]))
    out = docs.select(*(F.col(f"`{c}`") for c in keep))
    for k in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()  # about block_bytes
        out = _one_pass(out, docs.sparkSession.sparkContext.broadcast([(r["i"], r["t"]) for r in part]), text, window)
        if k + 1 < blocks:
            out = stage(out, "decontaminate")
    return out.select(*carry, "n_words", "n_hit", "items", "spans")


def _one_pass(docs: DataFrame, shared, text: str, window: int) -> DataFrame:
    later = "spans" in docs.columns
    docs = docs.withColumnsRenamed({"spans": "_spans", "items": "_items"}).drop("n_words", "n_hit") if later else docs

    def work():
        items = shared.value
        names = [i for i, _ in items]
        tables = build(items, window)

        def step(batch):
            data, offsets = raw(batch.column(text))
            rows = batch.num_rows
            norm, places, first = normalise(data, offsets)
            cover = np.zeros(len(places) + 1, np.int64)
            owners: list[set] = [set() for _ in range(rows)]
            for t in tables:
                place, member = t.search(norm)
                if not len(place):
                    continue
                begin = np.searchsorted(places, place)
                sizes = np.array([n for _, n, _ in t.patterns])[member]
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + sizes, -1)
                row = np.searchsorted(first, begin, side="right") - 1
                for r, m in set(zip(row.tolist(), member.tolist())):
                    owners[r].update(names[i] for i in t.patterns[m][2])
            if later:
                for r, (s, i) in enumerate(zip(batch.column("_spans").to_pylist(), batch.column("_items").to_pylist())):
                    owners[r].update(i)
                    pairs = np.frombuffer(s, "<i8").reshape(-1, 2) + first[r]
                    np.add.at(cover, pairs[:, 0], 1)
                    np.add.at(cover, pairs[:, 1], -1)
            hit = np.cumsum(cover[:-1]) > 0
            starts, ends, run_first = words(hit, first, hit)
            spans = np.stack([starts, ends], axis=1)
            return {
                "n_words": np.diff(first),
                "n_hit": row_sums(hit, first),
                "items": [sorted(o - {None}) for o in owners],
                "spans": [(spans[run_first[r] : run_first[r + 1]] - first[r]).astype("<i8").tobytes() for r in range(rows)],
            }

        return step

    found = map_texts(docs, work, "n_words long, n_hit long, items array<string>, spans binary", text)
    return found.drop("_spans", "_items")


def contaminated():
    """The rule: a hit word, and one word in twenty at least is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find(docs, benchmark, carry=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
