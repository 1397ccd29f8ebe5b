"""Bloom filters over long keys, built by Spark, of a checked size, for skipping rows early.

A false positive only lets a row through that a later exact step drops.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tastemill.llm.common import mix

#: Bits per key, and bounds of the filter's size (2**28 bits are 32 MB).
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    keys = keys.astype(np.int64).view(np.uint64)
    return [mix(keys ^ np.uint64(salt)) & np.uint64(bits - 1) for salt in (0x243F6A8885A308D3, 0x13198A2E03707344)]


def contains(filter_words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for at in places(keys, 64 * len(filter_words)):
        found &= (filter_words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def build(keys: DataFrame, column: str, rows: int) -> np.ndarray:
    """64-bit words of a filter that holds the long column's values; ``rows`` sets its size.

    Tasks emit the words they set; sums by word meet in Spark and the driver gets the filter, which
    is never larger than ``MOST_BITS``. Beyond that it lets more rows through. Nulls are left out.
    """
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_PER_KEY * rows):
        bits *= 2

    def run(batches):
        held = np.zeros(bits >> 6, np.uint64)
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in places(values, bits):
                np.bitwise_or.at(held, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(held)
        for a in range(0, len(some), 1 << 16):
            part = some[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[part].view(np.int64))], names=["word", "mask"])

    found = keys.where(F.col(column).isNotNull()).select(column).mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return out
