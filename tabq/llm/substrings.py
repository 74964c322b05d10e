"""Substring deduplication by difference-cover anchors.

Words are the symbols. Anchors are runs of :data:`ANCHOR` words that begin at a position whose remainder by
:data:`PERIOD` is in :data:`COVER`. Any remainder is a difference of two members of the cover, so for two equal
windows, wherever they stand in their documents, there is a shift under the period at which both have an anchor: equal
windows share an equal anchor. Only windows around an anchor that is found twice are looked at whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .blocks import MESSAGE, answers, buckets_for, hash_set, in_blocks, is_in, message, ordered, shared
from .common import table
from .hashing import Words, between, mix, owners, ranges, rolled, words

#: Fixed value: a perfect difference set modulo 21 (every remainder is a difference of two members).
COVER, PERIOD = (3, 6, 7, 12, 14), 21
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def anchors(w: Words, window: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every text with a whole window: the anchors' texts, first words and hashes."""
    n = np.diff(w.first)
    length = window - PERIOD + 1
    at = ranges(w.first[:-1], np.where(n >= window, n - length + 1, 0))
    owner = np.repeat(np.arange(len(n)), np.where(n >= window, n - length + 1, 0))
    pick = _IN_COVER[(at - w.first[owner]) % PERIOD]
    at, owner = at[pick], owner[pick]
    return owner, at, mix(between(sums, at, at + length))


def windows_near(w: Words, window: int, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First words of the windows that hold one of these anchors."""
    lo = np.maximum(at - (PERIOD - 1), w.first[owner])
    hi = np.minimum(at, w.first[owner + 1] - window)
    near = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(near, lo, 1)
    np.add.at(near, hi + 1, -1)
    return np.flatnonzero(np.cumsum(near[:-1]) > 0)


def substring_dedup(docs: DataFrame, window: int = 35) -> DataFrame:
    """Remove every word covered by a run of ``window`` words that begins anywhere else too, in any document or the same.

    Runs are judged on the input; words are taken as they are, whole texts are read. Returns ``doc_id, n_words,
    n_removed, kept_sha256, kept`` (the words left, joined by one space) for every row. A null, empty or short text
    loses nothing; a repeated row is another place, so both lose what is long enough. Other columns play no part.
    Window hashes have 64 bits: of a billion windows, some 3 in a hundred times one pair collides.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window must have over {PERIOD} words")
    blocks, size = in_blocks(docs)
    n_anchors, n_windows = buckets_for(size / 6 * len(COVER) / PERIOD), buckets_for(size / 6)

    def counted(block: int, h: np.ndarray, buckets: int) -> pa.Table:
        h, n = np.unique(h, return_counts=True)
        return message(block, h, buckets, (n > 1).astype(np.uint8))

    def first(key: tuple, rows: pa.Table) -> pa.Table:
        w = words(ordered(rows).column("text"))
        return counted(key[0].as_py(), anchors(w, window, rolled(w.hashes))[2], n_anchors)

    def extend(block: int, rows: pa.RecordBatch, payloads: list[bytes]) -> pa.Table:
        w = words(rows.column("text"))
        sums = rolled(w.hashes)
        owner, at, h = anchors(w, window, sums)
        hit = is_in(h, hash_set(payloads))
        start = windows_near(w, window, owner[hit], at[hit])
        return counted(block, mix(between(sums, start, start + window)), n_windows)

    def remove(block: int, rows: pa.RecordBatch, payloads: list[bytes]) -> pa.Table:
        w = words(rows.column("text"))
        n = np.diff(w.first)
        start = ranges(w.first[:-1], np.maximum(n - window + 1, 0))
        hit = start[is_in(mix(between(rolled(w.hashes), start, start + window)), hash_set(payloads))]
        edges = np.zeros(len(w.hashes) + 1, np.int64)
        np.add.at(edges, hit, 1)
        np.add.at(edges, hit + window, -1)
        gone = np.cumsum(edges[:-1]) > 0
        kept = np.flatnonzero(~gone)
        length = w.stop[kept] - w.start[kept] + 1  # with a space after each
        bytes_at = np.cumsum(length)
        out = np.append(w.data, np.uint8(0x20))[ranges(w.start[kept], length)]
        out[bytes_at - 1] = 0x20
        owner = owners(w.first)
        cuts = np.append(0, bytes_at)[np.searchsorted(kept, w.first)]
        texts = [out[a : max(a, b - 1)].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        removed = np.bincount(owner[gone], minlength=len(n))
        return pa.table({
            "doc_id": rows.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), "kept": pa.array(texts, pa.binary()).cast(pa.string()),
        })

    asked = blocks.groupBy("block").applyInArrow(first, MESSAGE)
    around = answers(blocks, shared(asked), extend, MESSAGE)
    return answers(blocks, shared(around), remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
runs AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
again AS (SELECT run FROM runs GROUP BY run HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM runs JOIN again USING (run)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
per AS (SELECT each.doc_id, count(gone.k) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY each.k) FILTER (gone.k IS NULL), '') AS kept FROM each LEFT JOIN gone USING (doc_id, k) GROUP BY each.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN per USING (doc_id)
"""
