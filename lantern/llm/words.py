"""Vectorised byte-level tokenisation shared by the text operators.

A word is a maximal run of bytes other than space, \\t, \\n, \\v, \\f and \\r, which is what
``bytes.split()`` separates by and what ``[^\\x20\\x09-\\x0D]+`` matches.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser over uint64 values."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per process and grown by doubling."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(have, out=have)
        _POWERS[int(base)] = have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (data[j] + 1) * BASE**j over j < i, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each span, equal for equal bytes wherever they stand."""
    with np.errstate(over="ignore"):
        raw = (prefix[end] - prefix[start]) * powers(int(start.max()) + 1 if len(start) else 1, BASE_INVERSE)[start]
        return mixed(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in data."""
    sep = SEPARATOR[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sep, [True])).view(np.int8)))
    return edge[0::2], edge[1::2]


def binary_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as large binary, nulls as empty values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")


def joined(texts: list[bytes], separator: bytes = b"\n") -> tuple[bytes, np.ndarray]:
    """The texts, each followed by the separator, and each one's offset (with the total at the end)."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + len(separator)
    return b"".join(x for t in texts for x in (t, separator)), np.concatenate(([0], np.cumsum(sizes)))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Send texts by BATCH_ROWS rows where the session has Spark's default of 10,000, in what is written inside; both sides hold a whole batch."""
    before = spark.conf.get(BATCH)
    if before == "10000":
        spark.conf.set(BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def free_names(frame: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column is called so in any case."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def released() -> None:
    """Give freed memory back to the system: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about `most` text bytes each (one row at least), with the column's bytes."""
    for batch in batches:
        texts = binary_column(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            held, end = 0, at
            while end < batch.num_rows and (end == at or held < most):
                held += len(texts[end].as_buffer() or b"")
                end += 1
            yield batch.slice(at, end - at), [x.as_py() for x in texts.slice(at, end - at)]
            at = end
    released()
