"""Word hashes of whole Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base modulo 2**64, and of its inverse."""
    if len(_tables[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _tables[k] = np.multiply.accumulate(t)
    return _tables[0], _tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolled(values: np.ndarray) -> np.ndarray:
    """Sums from which :func:`between` reads the hash of any run of ``values``."""
    pw, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * pw[: len(values)], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the runs ``start:stop``; equal runs have equal hashes wherever they stand."""
    _, inverse = powers(len(sums))
    return (sums[stop] - sums[start]) * inverse[start]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than texts) of an array of strings; null counts as empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text; one long text is a part of its own."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """The words of some texts: their bytes ``start:stop`` in ``data``, hashes, and ``first[i]:first[i + 1]``, those of text i."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = buffers(texts)
    full = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = full.copy(), full.copy()
    begins[1:] &= ~full[:-1] | edge[1:-1]
    ends[:-1] &= ~full[1:] | edge[1:-1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = rolled((_LOWER if lower else _SAME)[data].astype(np.uint64) + np.uint64(1))
    return Words(data, offsets, start, stop, np.searchsorted(start, offsets), mix(between(sums, start, stop)))


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each item, from ``first``."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ...``, ``length[i]`` of each, after one another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    head = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - head, length)
