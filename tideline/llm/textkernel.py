"""Whole-batch text scanning on Arrow buffers: no Python object per text or word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text scanned at a time; a longer text is a slice of its own.
SLICE = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _give_back() -> None:
    """Lets glibc return freed arrays at once: a Python worker is used again and again, and
    what it holds counts against its executor. Other C libraries are left as they are."""
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD, fixed
    except (OSError, AttributeError):
        pass


_give_back()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about ``limit`` bytes of text at most."""
    if not batch.num_rows:
        return
    _, offsets = buffer(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if buffers[1] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0]:offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inverse" if inverse else "base"
    if key not in _powers or len(_powers[key]) < n:
        with np.errstate(over="ignore"):
            made = np.full(max(n, SLICE + 1), INVERSE if inverse else BASE, np.uint64)
            made[0] = 1
            np.multiply.accumulate(made, out=made)
        if n > SLICE + 1:
            return made
        _powers[key] = made
    return _powers[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order (np.unique hashes, which takes many times as long)."""
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, row) of each whitespace-separated word; words end with their text."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    first[bounds] = inside[bounds]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[bounds - 1] = inside[bounds - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def range_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from one prefix sum of a polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[:len(data)], out=total[1:])
        raw = (total[stops] - total[starts]) * powers(len(data), inverse=True)[starts]
        return mix64(raw + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges between offsets."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
