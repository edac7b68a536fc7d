"""Shared helpers: reliable checkpoints, size-checked broadcasts, word hashing in numpy."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import reliable_checkpoint, shared_folder  # noqa: F401  (used by the operators)

#: The characters between words: space and U+0009 to U+000D, nothing else.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """A broadcast hint when ``df`` is counted at ``max_rows`` narrow rows or fewer.

    Beyond that the frame comes back without a hint, so that the join shuffles
    and adaptive execution splits its skewed partitions.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), applied elementwise."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def fold_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """One hash per position from equally long arrays; order and count matter."""
    total = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        total = (total + part) * _FOLD
        total ^= total >> _S31
    return mix64(total)


def release_memory() -> None:
    """Give back to the system what a task has freed, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, whose task gives its freed memory back when it ends."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        release_memory()

    return whole


def giving_back_groups(run: Callable[[pa.Table], pa.Table], least: int = 8 << 20) -> Callable[[pa.Table], pa.Table]:
    """``run`` over groups; the memory of one of ``least`` bytes or more is given back before the next."""

    def whole(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes >= least:
            release_memory()
        return out

    return whole


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most_bytes`` of ``column``, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    part = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:], strict=False):
        if high > low:
            yield batch.slice(low, high - low)
