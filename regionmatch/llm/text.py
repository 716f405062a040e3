"""Whole texts as byte buffers inside Arrow tasks: bounded slices, words, word hashes, rolling windows.

Every function works on the UTF-8 bytes of a slice of rows at once. A slice holds at most
``limit`` bytes of text, or one longer row, so a task's memory is set by the slice and by the
longest single row, never by its partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE = 2 << 20
LONG_WORD = 256
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_R = np.uint64(0xC2B2AE3D27D4EB4F)
U = np.uint64

#: Words are runs of bytes that are not blank: ``[^\x20\x09-\x0D]+``.
BLANKS = np.ones(256, bool)
BLANKS[[0x20, 9, 10, 11, 12, 13]] = False
#: Words of the contamination rule: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A to Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLAIN = np.zeros(256, bool)
PLAIN[0x30:0x3A] = PLAIN[0x61:0x7B] = PLAIN[0x80:] = True


def release() -> None:
    """Give memory that is free in this worker back to the system: workers stay between stages, and what one
    stage's arrays took would count against the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(fn):
    """``fn`` for one group, or for two that belong together, after which free memory is given back."""

    def settle(*tables):
        try:
            return fn(*tables)
        finally:
            release()

    return (lambda table: settle(table)) if fn.__code__.co_argcount == 1 else (lambda left, right: settle(left, right))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column without nulls (null becomes empty)."""
    arr = batch.column(batch.schema.get_field_index(name))
    arr = pc.fill_null(arr, "") if arr.null_count else arr
    return arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr


def buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary array."""
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = arr.buffers()
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind, len(arr) + 1 + arr.offset)[arr.offset:].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches, name: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in order as (rows, bytes, offsets), each slice of at most ``limit`` bytes or one row."""
    for batch in batches:
        data, offsets = buffer(column(batch, name))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
            at = end
    release()


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words and the row of each; words end at a row's end."""
    inside = table[data]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[first] = inside[first]
    end[:-1] &= ~inside[1:]
    last = first[first > 0] - 1
    end[last] = inside[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * _Q
    x = (x ^ (x >> U(29))) * _R
    return x ^ (x >> U(32))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: eight bytes a step, xxhash for ranges over LONG_WORD bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray((max(len(padded) - 7, 0),), "<u8", padded, strides=(1,))
    length = ends - starts
    out = length.astype(np.uint64) * _P
    left = np.flatnonzero((length > 0) & (length <= LONG_WORD))
    step = 0
    while len(left):
        rest = np.minimum(length[left] - step, 8).astype(np.uint64)
        keep = U(0xFFFFFFFFFFFFFFFF) >> ((U(8) - rest) << U(3))
        h = (out[left] ^ (loads[starts[left] + step] & keep)) * _Q
        out[left] = h ^ (h >> U(31))
        step += 8
        left = left[length[left] > step]
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes())
    return mix(out)


def rolling(x: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` neighbours, by doubling: log2(width) passes."""
    cur, size, out, done = x, 1, None, 0
    left = width
    if len(x) < width:
        return x[:0]
    while left:
        if left & 1:
            if out is None:
                out = cur
            else:
                m = len(cur) - done
                out = out[:m] * _Q + (cur[done:done + m] ^ (cur[done:done + m] >> U(29)))
            done += size
        left >>= 1
        if left:
            m = len(cur) - size
            cur = cur[:m] * _P + (cur[size:size + m] ^ (cur[size:size + m] >> U(31)))
            size *= 2
    return mix(out)


def whole(row: np.ndarray, width: int) -> np.ndarray:
    """Which windows of ``width`` neighbours lie in one row."""
    if len(row) < width:
        return np.zeros(0, bool)
    return row[: len(row) - width + 1] == row[width - 1:]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... counts[i] numbers each, end to end."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total, dtype=np.int64) + shift


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + lengths, n), -1)
    return np.cumsum(edge[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
