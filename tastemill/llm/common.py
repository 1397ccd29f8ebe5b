"""Helpers of the text operators: reading, batching by bytes, byte-level words and hashes."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that one numpy step works on; bounds a task's memory.
STEP_BYTES = 1 << 20
#: Rows of a batch that goes to Python, where the session sets none: some MB of usual texts.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def lean(spark: SparkSession) -> None:
    """Smaller batches between Spark and Python than the default, unless the session has its own."""
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``limit`` bytes together (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, one after another, and the row offsets; null counts as empty."""
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_texts(
    df: DataFrame,
    work: Callable[[], Callable[[pa.RecordBatch], dict]],
    schema: str,
    text: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """Carried columns plus the columns that ``work`` makes of each slice of rows.

    ``work`` is called once in each task and returns the function applied to every slice (a record
    batch); that returns one array per column of ``schema``. A carried column whose name clashes
    with a new one gives way to it.
    """
    lean(df.sparkSession)
    made = T._parse_datatype_string(schema)
    keep = [c for c in (df.columns if carry is None else carry) if c not in made.names]
    need = list(dict.fromkeys([*keep, text]))
    df = df.select(*(F.col(f"`{c}`") for c in need))
    out = T.StructType([df.schema[c] for c in keep] + made.fields)
    arrow = to_arrow_schema(made)

    def run(batches):
        step = work()
        for batch in batches:
            for part in steps(batch, text):
                new = step(part)
                columns = [part.column(c) for c in keep]
                columns += [pa.array(new[f.name], type=f.type) if not isinstance(new[f.name], pa.Array) else new[f.name].cast(f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)
            release()

    return df.mapInArrow(run, out)


def release() -> None:
    """Give free memory back to the system: the workers of an executor share one bound."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes, and for each row its first word.

    The third array has one entry more than rows: words of row r are first[r]:first[r + 1].
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.ascontiguousarray(inside)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begin[edges] = inside[edges]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run data[start:end], from one pass of running sums."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    power = np.full(n + 1, _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * power[:n], out=total[1:])
    value = total[ends] - total[starts]
    del total
    power[1:] = _BASE_INVERSE
    np.multiply.accumulate(power, out=power)
    return mix(value * power[starts] + (ends - starts).astype(np.uint64))


def window_hashes(items: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive item hashes."""
    n = len(items) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _BASE + items[k : n + k]
    return mix(out)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; empty rows have 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcast an object of this package with its class, which executors need not have installed."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast):
    return pickle.loads(shared.value)
