"""Arrow and numpy helpers that tasks of several operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

PIECE_BYTES = 4 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
#: Longer words get a digest: a polynomial modulo 2^64 has known collisions among words of 1,024 letters and more.
LONG_WORD = 256


def small_batches(spark: SparkSession, rows: int = 2000) -> SparkSession:
    """Bound what one Arrow batch of documents holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` text bytes; a longer text is a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one more for the end). Null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_table(separators: np.ndarray) -> np.ndarray:
    """Byte to byte: A-Z in lower case, separators to 0, 0 itself (never a word byte) to 0."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[separators] = 0
    return table


def spans(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of nonzero bytes inside a text, and the first run of each text (one more at the end)."""
    inside = np.zeros(len(codes) + 1, bool)
    inside[:-1] = codes != 0
    head = np.zeros(len(codes) + 1, bool)
    head[offsets] = True
    before = np.zeros(len(codes) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (head | ~before))
    ends = np.flatnonzero(before & (head | ~inside))
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))


def word_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """64-bit hash of every word: a polynomial, some words at a time so that temporaries stay small, or a digest of a long word."""
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    if not len(starts):
        return out
    powers = np.cumprod(np.full(int(lengths.max()), MULTIPLIER, np.uint64))
    total = np.cumsum(lengths)
    at = 0
    while at < len(starts):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + step, "right")))
        size = lengths[at:to]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        terms = _LETTERS[codes[np.repeat(starts[at:to], size) + place]] * powers[place]
        out[at:to] = np.add.reduceat(terms, first)
        at = to
    out = mixed(out ^ (lengths.astype(np.uint64) << np.uint64(48)))
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(codes[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def of_rows(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """The batch with further columns."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the length of each row's list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
