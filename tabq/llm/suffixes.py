"""Suffix-array deduplication: bytes of substrings that an earlier document has too.

Windows of :data:`WINDOW` bytes are dealt out by their anchor, the run of :data:`GRAM` bytes in them with the least
hash; equal windows have equal anchors at the same place. Windows of one document with one anchor make up a fragment. The
fragments around an anchor that more than one document has are gathered, and the suffix array over them shows which
windows are equal and which document is the first to have them. Fragments of the same bytes (hashes bring them together,
bytes are compared) count once, with their smallest document, in a block and again where blocks meet.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .blocks import MESSAGE, REPLY, answers, bucket_of, buckets_for, gaps, in_blocks, is_in, ordered, packed, replied, sent, unpacked
from .common import table
from .hashing import between, buffers, mix, ranges, rolled
from .suffix import suffix_ranks

WINDOW, GRAM = 50, 30
_SPAN = WINDOW - GRAM + 1
#: Bits of an anchor's hash beyond those that number all anchors: one in 2**SPARE looks shared and is not. The hash only says
#: what is looked at together; bytes decide.
SPARE = 12
#: Anchors of so many documents are hot: their fragments are cut into single windows, which are dealt out by their ends.
HOT = 256
ENDS = 16
BLOCK_BYTES = 2 << 20
#: How many equal hashes have their fragments' bytes compared in one go.
PAIRS = 1 << 13
#: How many bytes of fragments get their suffix arrays in one go.
AT_ONCE = 1 << 21
#: Bytes of texts whose fragments are found in one go, and for which there is one bucket of fragments.
SLICE_BYTES, BUCKET_BYTES = 1 << 18, 4 << 20
NO_ID = np.iinfo(np.int64).min
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Fragments:
    """Windows ``start .. last`` (of a block's bytes) with the anchor ``shift`` bytes further on."""

    start: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    group: np.ndarray
    shift: np.ndarray
    key: np.ndarray
    doc: np.ndarray

    def pick(self, which: np.ndarray) -> Fragments:
        return Fragments(*[getattr(self, f)[which] for f in self.__dataclass_fields__])

    def __add__(self, other: Fragments) -> Fragments:
        return Fragments(*[np.concatenate([getattr(self, f), getattr(other, f)]) for f in self.__dataclass_fields__])


def keys(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, shift: np.ndarray, group: np.ndarray) -> np.ndarray:
    """What tells a fragment from others: its bytes, anchor's place and group."""
    return mix(mix(between(sums, start, stop) + group) + (shift * 128 + (stop - start - WINDOW)).astype(np.uint64))


def anchor_hash(sums: np.ndarray, at: np.ndarray, drop: np.uint64) -> np.ndarray:
    """The anchors at these places. The least of many hashes is a small number; spread again, anchors fill all buckets alike."""
    return mix(mix(between(sums, at, at + GRAM))) >> drop << drop


def window_group(sums: np.ndarray, start: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The groups of single windows, by their ends and their anchor."""
    ends = mix(between(sums, start, start + ENDS)) + between(sums, start + WINDOW - ENDS, start + WINDOW)
    return mix(mix(ends) + anchor)


class Block:
    """A block's texts and their fragments."""

    def __init__(self, rows: pa.RecordBatch, bits: int = 64):
        self.drop = np.uint64(64 - bits)
        self.data, self.offsets = buffers(rows.column("text"))
        ids = rows.column("doc_id")
        self.ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)  # a null id comes before all others
        self.sums = rolled(_TABLE[self.data])

    def fragments(self) -> Fragments:
        """All fragments, found for some whole texts at a time."""
        none = np.zeros(0, np.int64)
        parts = [(none, none, none.view(np.uint64), none, none)]
        i = 0
        while i < len(self.ids):
            to = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + SLICE_BYTES, "right")) - 1)
            parts.append(self._found(i, to))
            i = to
        start, last, anchor, at, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        return self._keyed(start, last, anchor, at, anchor, doc)

    def _found(self, i: int, to: int) -> tuple[np.ndarray, ...]:
        """Of texts ``i .. to``: the first and last window, anchor, place of the anchor and document of each fragment."""
        offsets = self.offsets[i : to + 1] - self.offsets[i]
        begin, n = int(self.offsets[i]), int(offsets[-1])
        if n < WINDOW:
            none = np.zeros(0, np.int64)
            return none, none, none.view(np.uint64), none, none
        grams = np.arange(begin, begin + n - GRAM + 1)
        h = mix(between(self.sums, grams, grams + GRAM))
        # The least upper half of a hash; of equal ones the first. It must not depend on what stands around a window.
        least = (h >> np.uint64(32) << np.uint64(32)) | (grams - begin).astype(np.uint64)
        k, width = least, 1
        while 2 * width <= _SPAN:
            k = np.minimum(k[:-width], k[width:])
            width *= 2
        k = np.minimum(k[: len(k) - (_SPAN - width)], k[_SPAN - width :])
        windows = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
        start = ranges(offsets[:-1], windows)
        doc = np.repeat(np.arange(i, to), windows)
        at = (k[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start))[: len(first)] - 1
        at = at[first]
        return start[first] + begin, start[last] + begin, anchor_hash(self.sums, at + begin, self.drop), at + begin, self.ids[doc[first]]

    def _keyed(self, start: np.ndarray, last: np.ndarray, anchor: np.ndarray, at: np.ndarray, group: np.ndarray, doc: np.ndarray) -> Fragments:
        shift = at - start
        return Fragments(start, last, anchor, group, shift, keys(self.sums, start, last + WINDOW, shift, group), doc)

    def single_windows(self, f: Fragments) -> Fragments:
        """The windows of hot anchors' fragments, each a fragment of its own, grouped by its ends and place around the anchor."""
        start = ranges(f.start, f.last - f.start + 1)
        which = np.repeat(np.arange(len(f.start)), f.last - f.start + 1)
        anchor = f.anchor[which]
        return self._keyed(start, start, anchor, (f.start + f.shift)[which], window_group(self.sums, start, anchor), f.doc[which])

    def split_hot(self, f: Fragments, hot: np.ndarray) -> Fragments:
        is_hot = is_in(f.anchor, hot)
        return f.pick(~is_hot) + self.single_windows(f.pick(is_hot)) if is_hot.any() else f

    def alike(self, f: Fragments) -> tuple[Fragments, np.ndarray]:
        """The fragments in an order that brings equal ones together, by document, and which of them are not the same as the one before."""
        f = f.pick(sorted_by(f.doc, f.key))
        return f, differing(self.data, f.start, f.last - f.start + WINDOW, f.group, f.anchor, f.key)


def sorted_by(doc: np.ndarray, *keys_: np.ndarray) -> np.ndarray:
    """Order by the last of ``keys_`` first and ``doc`` at the end. A key that is the next one again says nothing, nor do documents
    that are in order already: sorting is stable."""
    by = [k for k, after in zip(keys_, (*keys_[1:], None), strict=True) if after is None or not np.array_equal(k, after)]
    if (doc[1:] < doc[:-1]).any():
        by.insert(0, doc)
    return np.lexsort(by)


def runs_of(values: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbours of one fragment (``windows`` of each) as values and lengths."""
    n = windows.astype(np.int64)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[np.cumsum(n) - n] = True
    at = np.flatnonzero(new)
    return values[at], np.diff(np.append(at, len(values))).astype(np.uint8)


def differing(data: np.ndarray, start: np.ndarray, n: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Which runs ``start, n`` of ``data`` are not the one before again. Only those are compared that agree in ``same``
    (hashes, which bring equal runs together); bytes decide."""
    near = np.ones(len(n), bool)
    near[:1] = False
    for x in (*same, n):
        near[1:] &= x[1:] == x[:-1]
    near = np.flatnonzero(near)
    new = np.ones(len(n), bool)
    for k in range(0, len(near), PAIRS):
        at = near[k : k + PAIRS]
        unlike = data[ranges(start[at], n[at])] != data[ranges(start[at - 1], n[at])]
        new[at] = np.logical_or.reduceat(unlike, np.cumsum(n[at]) - n[at])
    return new


def firsts(bytes_: np.ndarray, length: np.ndarray, windows: np.ndarray, doc: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For every window of these fragments, the smallest document that has it in a fragment of the same group.

    Fragments of a group come together. A group of one has nothing to be compared with.
    """
    begin = np.cumsum(length) - length
    first_window = np.cumsum(windows) - windows
    out = np.repeat(doc, windows)
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    heads = np.append(np.flatnonzero(new), len(group))
    several = np.flatnonzero(np.diff(heads) > 1)
    if not len(several):
        return out
    weight = np.add.reduceat(length + 1, heads[:-1])[several]
    several, weight = several[np.argsort(weight, kind="stable")], np.sort(weight)  # arrays of like size take like many steps
    # The eight bytes from every place on, to compare windows by.
    eights = np.ndarray(len(bytes_) - 7, np.uint64, bytes_, strides=(1,)).copy()
    done = 0
    while done < len(several):
        to = max(done + 1, int(np.searchsorted(np.cumsum(weight[done:]), AT_ONCE, "right")) + done)
        mine = several[done:to]
        done = to
        n = heads[mine + 1] - heads[mine]
        f = ranges(heads[mine], n)
        sized = length[f] + 1
        stop = np.cumsum(sized)
        symbols = np.ones(int(stop[-1]), np.int64)  # 1 ends a fragment, 0 a group's text
        inside = np.ones(len(symbols), bool)
        inside[stop - 1] = False
        source = ranges(begin[f], length[f])
        symbols[inside] = bytes_[source].astype(np.int64) + 2
        ends = np.cumsum(n)
        symbols[stop[ends - 1] - 1] = 0
        bounds = np.append(0, stop[ends - 1])
        rank = suffix_ranks(symbols, bounds)
        start = ranges(stop - sized, windows[f])
        slot = ranges(first_window[f], windows[f])
        owner = np.repeat(doc[f], windows[f])
        order = np.argsort(rank[start])
        at = ranges(begin[f], windows[f])[order]
        of = np.repeat(np.arange(len(n)), np.add.reduceat(windows[f], ends - n))[order]
        same = np.zeros(len(at), bool)
        same[1:] = of[1:] == of[:-1]
        for k in (*range(0, WINDOW - 8, 8), WINDOW - 8):
            part = eights[at + k]
            same[1:] &= part[1:] == part[:-1]
        runs = np.flatnonzero(~same)
        low = np.minimum.reduceat(owner[order], runs)
        out[slot[order]] = np.repeat(low, np.diff(np.append(runs, len(at))))
    return out


def compared(group: np.ndarray, doc: np.ndarray, n: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of fragments (``data`` has the ``n`` bytes of each), those of which a window is found in an earlier document than theirs, the number
    of their windows, and for each of these the smallest document.

    Fragments of the same bytes in one group count once in the suffix array, with the smallest document.
    """
    begin = np.cumsum(n) - n
    key = keys(rolled(_TABLE[data]), begin, begin + n, np.zeros(len(n), np.int64), group)
    order = np.lexsort((doc, key, n, group))
    new = differing(data, begin[order], n[order], group[order], key[order])
    heads = order[new]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    windows = n[heads] - WINDOW + 1
    least = firsts(data[ranges(begin[heads], n[heads])], n[heads], windows, doc[heads], group[heads])
    first_window = np.cumsum(windows) - windows
    lowest = np.minimum.reduceat(least, first_window)
    mine = np.flatnonzero(lowest[number] < doc)
    k = number[mine]
    return mine, windows[k], least[ranges(first_window[k], windows[k])]


def groups_of(data: np.ndarray, begin: np.ndarray, n: np.ndarray, shift: np.ndarray, hot: np.ndarray, drop: np.uint64) -> np.ndarray:
    """The groups of fragments, from their bytes, for some fragments at a time."""
    group = np.empty(len(n), np.uint64)
    i = 0
    while i < len(n):
        to = int(np.searchsorted(begin, begin[i] + AT_ONCE))
        at = begin[i:to] - begin[i]
        sums = rolled(_TABLE[data[begin[i] : begin[to - 1] + n[to - 1]]])
        group[i:to] = anchor_hash(sums, at + shift[i:to], drop)
        single = np.flatnonzero(hot[i:to])
        group[i + single] = window_group(sums, at[single], group[i + single])
        i = to
    return group


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Remove every byte covered by a :data:`WINDOW`-byte string that also starts in a document with a smaller ``doc_id``.

    Texts are UTF-8 bytes (null: empty), strings never cross documents, and are judged on the input. Returns ``doc_id, n_bytes,
    n_removed, n_spans, kept_sha256, kept`` (the bytes left) for every row. Short texts lose nothing. Rows that repeat an
    id do not count against each other; a null id comes before all others. Other columns play no part.
    """
    blocks, size = in_blocks(docs, BLOCK_BYTES)
    anchors = size * 2 / (_SPAN + 1)
    n_anchors, n_fragments = buckets_for(anchors), max(1, -(-size // BUCKET_BYTES))
    bits = min(64, 8 * -(-(int(anchors).bit_length() + SPARE) // 8))

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        """Each anchor once, with the number of documents that have it."""
        f = Block(ordered(rows), bits).fragments()
        order = sorted_by(f.doc, f.anchor)
        a, d = f.anchor[order], f.doc[order]
        new, more = np.ones(len(a), bool), np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        more[1:] = new[1:] | (d[1:] != d[:-1])
        heads = np.flatnonzero(new)
        n = np.add.reduceat(more.astype(np.int32), heads) if len(heads) else heads.astype(np.int32)
        a = a[heads]

        def pack(x: int, y: int) -> bytes:
            return packed(gaps(a[x:y]), n[x:y].astype(np.int32))

        return sent(bucket_of(a, n_anchors), n_anchors, key[0].as_py(), pack)

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        """Answers each block with its anchors that several documents have, and those of them that are hot."""
        owner = rows.column("block").to_pylist()
        got = [unpacked(p, np.uint64, np.int32) for p in rows.column("payload").to_pylist()]
        each = [np.cumsum(g[0], dtype=np.uint64) for g in got]
        h, inverse = np.unique(np.concatenate(each), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([g[1] for g in got]).astype(float))
        cuts = np.cumsum([0, *[len(x) for x in each]])
        out = []
        for b, x, a, e in zip(owner, each, cuts[:-1], cuts[1:], strict=True):
            mine = n[inverse[a:e]]
            if (mine > 1).any():
                out.append((b, packed(gaps(x[mine > 1]), gaps(x[mine >= HOT]))))
        return replied(out)

    def send(block: int, rows: pa.RecordBatch, payloads: list[bytes]) -> pa.Table:
        """The different fragments around these anchors, each with the smallest document that has it."""
        got = [unpacked(p, np.uint64, np.uint64) for p in [*payloads, packed(*[np.zeros(0, np.uint64)] * 2)]]
        held, hot = (np.sort(np.concatenate([np.cumsum(g[i], dtype=np.uint64) for g in got])) for i in (0, 1))
        here = Block(rows, bits)
        f = here.fragments()
        f = here.split_hot(f.pick(is_in(f.anchor, held)), hot)
        f, new = here.alike(f)
        f = f.pick(new)

        bucket = bucket_of(f.group, n_fragments)
        order = np.lexsort((f.start, bucket))
        f, bucket = f.pick(order), bucket[order]
        # The place of the anchor, from which the group follows, and whether it is hot.
        shift = (f.shift + np.where(f.group != f.anchor, 128, 0)).astype(np.uint8)

        def pack(x: int, y: int) -> bytes:
            n = f.last[x:y] - f.start[x:y] + WINDOW
            return packed(gaps(f.start[x:y].astype(np.int32)), gaps(f.doc[x:y]), n.astype(np.uint8), shift[x:y], here.data[ranges(f.start[x:y], n)], hot[:0])

        out = sent(bucket, n_fragments, block, pack)
        if len(hot):  # to itself, by way of any bucket: what it has to cut into windows again
            note = packed(*[hot[:0]] * 5, hot)
            out = pa.concat_tables([out, pa.table({"bucket": pa.array([block % n_fragments], pa.int32()), "block": pa.array([block], pa.int32()), "payload": pa.array([note], pa.binary())})])
        return out

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        """Answers each block with those of its fragments of which a window is found in an earlier document than it sent."""
        owner = rows.column("block").to_numpy()
        got = [unpacked(p, np.int32, np.int64, np.uint8, np.uint8, np.uint8, np.uint64) for p in rows.column("payload").to_pylist()]
        out = [(int(b), packed(g[0], g[1], g[2], g[2], g[5])) for b, g in zip(owner, got, strict=True) if len(g[5])]
        block = np.repeat(owner, [len(g[0]) for g in got])
        if not len(block):
            return replied(out)
        place, doc = (np.concatenate([np.cumsum(g[i], dtype=t) for g in got]) for i, t in ((0, np.int32), (1, np.int64)))
        n, shift, data = (np.concatenate([g[i] for g in got]) for i in (2, 3, 4))
        del got
        n = n.astype(np.int64)
        begin = np.cumsum(n) - n
        group = groups_of(data, begin, n, (shift & 127).astype(np.int64), shift >= 128, np.uint64(64 - bits))
        order = np.argsort(group, kind="stable")
        # Some groups at a time, as what is made of them is many times larger.
        spread = group[order]
        parts = max(1, -(-len(data) // AT_ONCE))
        cuts = [0, *[int(np.searchsorted(spread, spread[k * len(spread) // parts])) for k in range(1, parts)], len(spread)]
        found = []
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            if a < e:
                some = np.sort(order[a:e])
                mine, windows, low = compared(group[some], doc[some], n[some], data[ranges(begin[some], n[some])])
                found.append((some[mine], windows, low))
        which, windows, low = (np.concatenate(x) for x in zip(*found, strict=True))
        start = np.cumsum(windows) - windows
        by_block = np.lexsort((which, block[which]))
        ends = np.append(np.flatnonzero(np.append(True, np.diff(block[which[by_block]]) != 0)) if len(which) else [], len(which)).astype(np.int64)
        for a, e in zip(ends[:-1], ends[1:], strict=True):
            k = by_block[a:e]
            answer = low[ranges(start[k], windows[k])]
            out.append((int(block[which[k[0]]]), packed(place[which[k]], *runs_of(answer, windows[k]), windows[k].astype(np.uint8), np.zeros(0, np.uint64))))
        return replied(out)

    def remove(block: int, rows: pa.RecordBatch, payloads: list[bytes]) -> pa.Table:
        here = Block(rows, bits)
        got = [unpacked(p, np.int32, np.int64, np.uint8, np.uint8, np.uint64) for p in payloads]
        hot = np.unique(np.concatenate([g[4] for g in got])) if got else np.zeros(0, np.uint64)
        f, new = here.alike(here.split_hot(here.fragments(), hot))
        windows = f.last - f.start + 1
        # What the block knows itself: equal fragments of its own documents.
        number = np.cumsum(new) - 1
        heads = np.flatnonzero(new)  # each has the smallest document, and is what was sent
        start = ranges(f.start, windows)
        doc, least = np.repeat(f.doc, windows), np.repeat(f.doc[heads][number], windows)
        if got:
            aplace = np.concatenate([g[0] for g in got]).astype(np.int64)
            alow = np.repeat(np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got]))
            an = np.concatenate([g[3] for g in got]).astype(np.int64)
            abegin = np.cumsum(an) - an
            order = np.argsort(aplace)
            aplace, an, abegin = aplace[order], an[order], abegin[order]
            sent_as = f.start[heads][number]
            hit = np.flatnonzero(is_in(sent_as, aplace))
            to = np.searchsorted(aplace, sent_as[hit])
            first_window = np.cumsum(windows) - windows
            mine = ranges(first_window[hit], windows[hit])
            least[mine] = np.minimum(least[mine], alow[ranges(abegin[to], an[to])])
        start = start[least < doc]
        edges = np.zeros(len(here.data) + 1, np.int64)
        np.add.at(edges, start, 1)
        np.add.at(edges, start + WINDOW, -1)
        gone = np.cumsum(edges[:-1]) > 0
        o = here.offsets
        total = np.append(0, np.cumsum(gone))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = o[:-1][np.diff(o) > 0]
        opens[inner] = gone[inner]
        spans = np.append(0, np.cumsum(opens))
        kept = here.data[~gone]
        cuts = o - total[o]
        texts = [kept[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({
            "doc_id": rows.column("doc_id"), "n_bytes": pa.array(np.diff(o), pa.int64()), "n_removed": pa.array(np.diff(total[o]), pa.int64()),
            "n_spans": pa.array(np.diff(spans[o]), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), "kept": pa.array(texts, pa.binary()),
        })

    held = blocks.groupBy("block").applyInArrow(ask, MESSAGE).groupBy("bucket").applyInArrow(count, REPLY)
    found = answers(blocks, held, send, MESSAGE)
    return answers(blocks, found.groupBy("bucket").applyInArrow(compare, REPLY), remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, base, substr(h, 2 * base + 1, 2098) AS part FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 1000)) AS base FROM d)),
runs AS (SELECT doc_id, base + j AS i, substr(part, 2 * j - 1, 100) AS run FROM (SELECT doc_id, base, part, unnest(range(1, least(1001, len(part) // 2 - 48))) AS j FROM parts)),
firsts AS (SELECT run, min(doc_id) AS least FROM runs GROUP BY run HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i FROM runs JOIN firsts USING (run) WHERE least < doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM hits),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS b FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
per AS (SELECT doc_id, count(*) AS n_spans, sum(b - a + 1) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS head FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""
