"""What several operators of this package share."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriweave.session import find_package, staged

# Rows and bytes of a batch that Spark hands to a Python worker.
BATCH_ROWS = 1000
BATCH_BYTES = 16 * 1024 * 1024


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that very long texts do not add up in a worker, and let workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    find_package(spark)


def settled(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back, as a step of a long job.

    Spark removes the shuffle files of a plan once the driver has let go of it. Steps
    before this one are done with, so what they left is collected first; otherwise the
    files of all steps would lie on disk together.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return staged(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id`` and ``text`` only, a missing text as the empty one; other columns cannot clash any more.

    Columns to ``keep`` follow as ``_kept0``, ``_kept1`` and so on.
    """
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
        *[F.col(c).alias(f"_kept{i}") for i, c in enumerate(keep)],
    )


def with_kept(schema: str, docs: DataFrame, keep: Sequence[str]) -> T.StructType:
    """The schema with the kept columns behind it."""
    out = T.StructType.fromDDL(schema)
    for i, column in enumerate(keep):
        out = out.add(f"_kept{i}", docs.schema[column].dataType)
    return out


def restored(keep: Sequence[str], **changed: Column) -> list[Column]:
    """The kept columns under their own names; the ``changed`` ones from the given expressions."""
    return [changed[c].alias(c) if c in changed else F.col(f"_kept{i}").alias(c) for i, c in enumerate(keep)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow text column (no nulls) and the n + 1 offsets of its rows, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    starts = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(batch: pa.RecordBatch, most_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``most_bytes`` of text each (a longer text comes alone)."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[row] + most_bytes, side="right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row)
        row = end


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the number of values per row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (a multiply and xor-shift finaliser)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_HELD: dict[str, Callable[[], None]] = {}


def hold(owner: str, release: Callable[[], None]) -> None:
    """Say that a worker process keeps tables for an operator from now on; those of other operators are released.

    Spark uses its Python workers again for later stages, so what an earlier operator left
    would otherwise add up with what the running one needs.
    """
    for other in [o for o in _HELD if o != owner]:
        _HELD.pop(other)()
        pa.default_memory_pool().release_unused()
    _HELD[owner] = release


def let_go(owner: str) -> None:
    """Release the tables of operators other than this one; those of ``rolling`` belong to several."""
    for other in [o for o in _HELD if o not in (owner, "rolling")]:
        _HELD.pop(other)()


def give_back() -> None:
    """Hand memory that this process has freed back to the system; allocators keep much of it otherwise."""
    pa.default_memory_pool().release_unused()
    # Only glibc has this.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(work: Callable) -> Callable:
    """A task's function that begins without the tables of other operators and leaves no freed memory in the worker process.

    An executor keeps its Python workers between tasks, so what each of them holds on to
    counts all the time, with what the running tasks need.
    """
    owner = work.__module__.rpartition(".")[2]

    def one_by_one(*args) -> Iterator:
        let_go(owner)
        try:
            yield from work(*args)
        finally:
            give_back()

    def whole(*args):
        let_go(owner)
        try:
            return work(*args)
        finally:
            give_back()

    inner = one_by_one if inspect.isgeneratorfunction(work) else whole
    # Spark counts the arguments: batches, or the key and the rows of a group.
    if len(inspect.signature(work).parameters) == 1:
        return functools.wraps(work)(lambda batches: inner(batches))
    return functools.wraps(work)(lambda key, rows: inner(key, rows))


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; the largest asked so far is kept in the worker."""
    key = (base, 0)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        hold("rolling", _POWERS.clear)
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 21:
            _POWERS[key] = have
    return have[:n]


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Rolling:
    """Hashes of any piece of a byte array in constant time: polynomial sums modulo 2 ** 64, mixed."""

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        # Bytes are spread over 64 bits first, so that low bits of the sums are well mixed too.
        np.cumsum(_SPREAD[raw] * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(_INVERSE, n + 1)

    def pieces(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of ``raw[start:end]`` for each pair; equal pieces have equal hashes."""
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """Hash of every run of k bytes, by start."""
        if len(self.sums) <= k:
            return np.empty(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.back[: len(self.sums) - k] + np.uint64(k))


_SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)

# Bytes that end a word of the shingle contract, as a lookup table.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of every row, and the first word of each row (n + 1 values).

    ``breaks``: the table of bytes that belong to no word. Words do not cross rows.
    """
    inside = ~breaks[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[1:-1][offsets[1:-1] < len(raw)]
    starts = inside & ~before
    starts[edges] = inside[edges]
    ends = np.empty_like(inside)
    ends[-1:] = inside[-1:]
    ends[:-1] = inside[:-1] & ~inside[1:]
    cut = edges[edges > 0] - 1
    ends[cut] = inside[cut]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets)


def partitions_for(df: DataFrame, bytes_each: int = 32 * 1024 * 1024) -> int:
    """Partitions for a shuffle of the whole frame: by its size as Spark knows it, and no fewer than the session's setting."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_each)), 1 << 20)
