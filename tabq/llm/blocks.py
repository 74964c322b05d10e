"""Hash look-ups between blocks of documents and buckets of hashes.

Documents are dealt into blocks of a few MB. A block sends each distinct hash once, packed by bucket; a bucket sees all
of a hash's blocks and answers each. So a hash that a third of all documents holds reaches its bucket once a block, and
texts stay where they are: the exchange that deals them out is used again for every step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: About how many bytes of text a block has, and how many hashes a bucket.
BLOCK_BYTES = 4 << 20
BUCKET_HASHES = 1 << 20
MESSAGE, REPLY = "bucket int, block int, payload binary", "block int, payload binary"


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``block, doc_id, text`` of every row (a null text is an empty one), and the bytes of all texts."""
    text = text_of(docs)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    doc_id = docs["doc_id"].cast("long")
    return docs.select(F.pmod(F.xxhash64(doc_id, text), F.lit(n)).cast("int").alias("block"), doc_id.alias("doc_id"), text.alias("text")), size


def buckets_for(hashes: float) -> int:
    return max(1, int(-(-hashes // BUCKET_HASHES)))


def ordered(rows: pa.Table) -> pa.RecordBatch:
    """A block's rows in an order that every step finds again."""
    order = pc.sort_indices(rows, [("doc_id", "ascending"), ("text", "ascending")])
    out = rows.take(order).combine_chunks()
    text = out.column("text").cast(pa.large_string()).combine_chunks()
    return pa.RecordBatch.from_arrays([out.column("doc_id").combine_chunks(), text], names=["doc_id", "text"])


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def message(block: int, hashes: np.ndarray, buckets: int, *more: np.ndarray) -> pa.Table:
    """``hashes`` (sorted) and arrays beside them, packed by bucket: bucket numbers rise with the hashes."""
    cuts = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cuts))
    payload = [b"".join([np.int64(cuts[b + 1] - cuts[b]).tobytes(), *[a[cuts[b] : cuts[b + 1]].tobytes() for a in (hashes, *more)]]) for b in used]
    return pa.table({"bucket": pa.array(used, pa.int32()), "block": pa.array(np.full(len(used), block), pa.int32()), "payload": pa.array(payload, pa.binary())})


def opened(payload: bytes, *types: type) -> list[np.ndarray]:
    """The arrays of a payload: hashes, then those of ``types``."""
    n, at, out = int(np.frombuffer(payload, np.int64, 1)[0]), 8, []
    for t in (np.uint64, *types):
        out.append(np.frombuffer(payload, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def shared(messages: DataFrame) -> DataFrame:
    """Answers each block with those of its hashes that are found twice or more: in two blocks, or, by the byte beside the
    hash, in one."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        blocks = rows.column("block").to_pylist()
        got = [opened(p, np.uint8) for p in rows.column("payload").to_pylist()]
        h, twice = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.argsort(h, kind="stable")
        s, t = h[order], twice[order] > 0
        if len(s) > 1:
            same = s[1:] == s[:-1]
            t[1:] |= same
            t[:-1] |= same
        hit = np.zeros(len(h), bool)
        hit[order] = t
        ends = np.cumsum([0, *[len(g[0]) for g in got]])
        out = [(b, h[a:e][hit[a:e]]) for b, a, e in zip(blocks, ends[:-1], ends[1:], strict=True) if hit[a:e].any()]
        return pa.table({"block": pa.array([x[0] for x in out], pa.int32()), "payload": pa.array([x[1].tobytes() for x in out], pa.binary())})

    return messages.groupBy("bucket").applyInArrow(run, REPLY)


def answers(docs: DataFrame, replies: DataFrame, run: Callable[[pa.RecordBatch, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """``run`` on every block's rows and what was answered to it."""

    def both(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return run(key[0].as_py(), ordered(left), right.column("payload").to_pylist())

    return docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(both, schema)


def hash_set(payloads: Iterable[bytes]) -> np.ndarray:
    parts = [np.frombuffer(p, np.uint64) for p in payloads]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def is_in(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(found):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(found, values), len(found) - 1)
    return found[at] == values


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of any lengths and types, compressed; :func:`unpacked` gives them back."""
    parts = [np.array([len(a) for a in arrays], np.int64).tobytes()]
    for a in arrays:  # bytes of one weight together compress better
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpacked(payload: bytes, *types: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    counts, at, out = np.frombuffer(raw, np.int64, len(types)), 8 * len(types), []
    for n, t in zip(counts, types, strict=True):
        wide = np.dtype(t).itemsize
        a = np.frombuffer(raw, np.uint8, int(n) * wide, at)
        out.append(np.ascontiguousarray(a.reshape(wide, n).T).reshape(-1).view(t) if n else np.zeros(0, t))
        at += int(n) * wide
    return out


def sent(bucket: np.ndarray, buckets: int, block: int, pack: Callable[[int, int], bytes]) -> pa.Table:
    """Messages to the buckets; ``bucket`` is sorted and ``pack`` packs a range of it."""
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cuts))
    return pa.table({"bucket": pa.array(used, pa.int32()), "block": pa.array(np.full(len(used), block), pa.int32()), "payload": pa.array([pack(int(cuts[b]), int(cuts[b + 1])) for b in used], pa.binary())})


def replied(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})


def gaps(rising: np.ndarray) -> np.ndarray:
    """A rising array's first value and differences, which compress well; its ``cumsum`` is the array again."""
    out = rising.copy()
    out[1:] -= rising[:-1]
    return out
