"""Helpers that several operators share: tables in the shared folder, runs of sorted Arrow rows, text blocks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import mark, release, stored  # noqa: F401  they are the operators' too


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Memory that this worker has freed goes back to the machine: idle workers count in an executor's memory."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(step):
    """A function of batches whose worker gives back what it has freed when it ends."""

    @wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def lean_group(step):
    """A function of two groups' tables whose worker gives back what it has freed after each."""

    @wraps(step)
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return step(left, right)
        finally:
            give_back()

    return run


def crc32_of_id(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of the rows that share the keys, from batches sorted by them; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for s in starts:
            held.append(batch.slice(at, s - at))
            yield pa.Table.from_batches(held)
            held, at = [], s
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def utf8_block(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column one after the other, and where each row begins (one more entry ends the last); null: no bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about most_bytes of text, so that work arrays stay small; a longer text is a part of its own."""
    _, at = utf8_block(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(at, at[start] + most_bytes, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
