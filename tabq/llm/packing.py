"""Packing of documents into sequences of one length: online sum-of-squares placing.

A document goes to the fill level at which the sum of squared counts of partly filled windows grows least. The counts by
level are all that the choice looks at. Tasks pack their own rows; nothing is shuffled.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, text_of
from .hashing import slices

Piece = tuple[int, int, bytes, int]  # doc_id, start, ids (little-endian, 4 bytes each), tokens of the whole document
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class LevelPacker:
    """Windows of ``size`` tokens. ``count[h]`` is the number of partly filled windows that hold ``h`` tokens."""

    def __init__(self, size: int, close: Callable[[list[Piece]], None]):
        self.size, self.close = size, close
        self.count = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def level_for(self, n: int) -> int:
        """The fill level (0: a new window) where ``n`` tokens make the sum of squares smallest; the fullest of equals."""
        c = self.count[1 : self.size - n + 1]
        grown = self.count[n + 1 : self.size + 1].copy()
        if len(grown):
            grown[-1] = -1  # a full window is none that counts
        cost = np.where(c > 0, 2 * (grown - c) + 2, np.iinfo(np.int64).max)
        fresh = 2 * self.count[n] + 1 if n < self.size else 0
        if len(cost) and (best := int(cost.min())) <= fresh:
            return len(cost) - int(np.argmin(cost[::-1]))
        return 0

    def place(self, piece: Piece) -> None:
        n = len(piece[2]) // 4
        if n == self.size:
            self.close([piece])
            return
        h = self.level_for(n)
        window = [] if h == 0 else self.open[h].pop()
        if h:
            self.count[h] -= 1
        window.append(piece)
        if h + n == self.size:
            self.close(window)
        else:
            self.count[h + n] += 1
            self.open.setdefault(h + n, []).append(window)

    def add(self, doc_id: int, ids: bytes) -> None:
        """A document longer than a window fills whole ones first."""
        step, n = 4 * self.size, len(ids) // 4
        for at in range(0, len(ids), step):
            self.place((doc_id, at // 4, ids[at : at + step], n))

    def finish(self) -> None:
        """Fill the fullest open windows with tokens of the emptiest, cutting where needed; the last rest, under one
        window, is cut into powers of two. So no sequence needs padding."""
        left = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open.clear()
        self.count[:] = 0
        lo, hi = 0, len(left) - 1
        while lo < hi:
            gap = self.size - sum(len(p[2]) for p in left[lo]) // 4
            doc, start, ids, total = left[hi].pop()
            take = min(gap, len(ids) // 4)
            left[lo].append((doc, start, ids[: 4 * take], total))
            if 4 * take < len(ids):
                left[hi].append((doc, start + take, ids[4 * take :], total))
            if not left[hi]:
                hi -= 1
            if take == gap:
                self.close(left[lo])
                lo += 1
        rest = left[lo] if lo == hi else []
        while rest:
            n = sum(len(p[2]) for p in rest) // 4
            gap, window = 1 << (n.bit_length() - 1), []
            while gap:
                doc, start, ids, total = rest.pop()
                take = min(gap, len(ids) // 4)
                window.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    rest.append((doc, start + take, ids[4 * take :], total))
                gap -= take
            self.close(window)


class WordCache:
    """Token ids by white-space separated chunk, as bytes. The vocabulary drops white space and no token crosses it.

    Chunks of over ``most`` bytes become the old ones, of which those that come again are kept, so twice ``most`` is held;
    long chunks are never kept. Results do not depend on it.
    """

    def __init__(self, vocabulary: str, most: int = 64 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known, self.old, self.held = Tokenizer.from_str(vocabulary), most, {}, {}, 0
        mark = json.loads(vocabulary)["model"].get("end_of_word_suffix")
        pieces = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(pieces.values()) + 1, bool)
        self.ends[[i for p, i in pieces.items() if mark and p.endswith(mark)]] = True

    def _encoded(self, chunks: list[str]) -> dict[str, bytes]:
        """Words of letters alone are one piece each, with a token that ends a word last: they are encoded many at a time."""
        plain = [c for c in chunks if c.isalpha()]
        lines = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        alone = [c for c in chunks if not c.isalpha()]
        found = {}
        for line, e in zip(lines, self.tokenizer.encode_batch([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(line):
                raw, cuts = ids.tobytes(), (4 * cuts).tolist()
                found.update(zip(line, (raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
            else:
                alone += line
        for at in range(0, len(alone), 256):
            some = alone[at : at + 256]
            for c, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                found[c] = np.asarray(e.ids, "<u4").tobytes()
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > self.most:
            self.known, self.old, self.held = {}, self.known, 0
        known, old = self.known, self.old
        split = []
        for t in texts:
            # Python also splits at four control characters that are no white space to the tokenizer.
            split.append([t] if _ODD.search(t) else _lowered(t).split())
        fresh, todo, two = {}, [], {}
        for c in set().union(*split).difference(known):
            if (v := old.get(c)) is not None:
                fresh[c] = v
            elif c.isalpha() or (p := _parts(c)) is None:
                todo.append(c)
            else:
                two[c] = p
        pieces = {p for pair in two.values() for p in pair}.difference(known, fresh)
        fresh.update((p, old[p]) for p in pieces & old.keys())
        fresh.update(self._encoded(list(pieces.difference(old).union(todo))))
        known.update(fresh)
        for c, (word, marks) in two.items():
            fresh[c] = known[word] + known[marks]
        known.update(fresh)
        out = [b"".join(map(known.__getitem__, s)) for s in split]
        for c in [c for c in fresh if len(c) > LONGEST]:
            del known[c], fresh[c]
        self.held += ENTRY * len(fresh) + sum(map(len, fresh)) + sum(map(len, fresh.values()))
        return out


#: Chunks of more characters are encoded each time; the bytes that an entry takes besides its text and ids.
LONGEST, ENTRY = 64, 190
_ODD = re.compile("[\x1c-\x1f]")
_MARKED = re.compile(r"([^\W\d_]+)([!-/:-@\[-^`{-~]+)")


def _lowered(text: str) -> str:
    """The text as the tokenizer normalises it, where that is sure to give the same ids, so that more is found again."""
    if "<|" in text:  # may begin a special token, which is looked for before normalising
        return text
    if text.isascii():
        return text.lower()
    if "\u03a3" in text or "\u0130" in text:  # the two letters whose lower case depends on the program
        return text
    low = text.lower()
    return low if unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low) else text


def _parts(chunk: str) -> tuple[str, str] | None:
    """A word and the ASCII marks after it, which the tokenizer takes apart anyway.

    Only where normalising keeps the word all letters: some letters become a letter and a combining mark, which the
    tokenizer then takes together with the marks.
    """
    m = _MARKED.fullmatch(chunk)
    if m and (m[1].isascii() or "\u0130" not in m[1] and unicodedata.normalize("NFC", m[1]).lower().isalpha()):
        return m[1], m[2]
    return None


_caches: dict[int, WordCache] = {}
#: What a task should have to place, by Spark's estimate of the input.
TASK_BYTES = 2 << 20


def merged(docs: DataFrame) -> DataFrame:
    """``docs`` without needlessly small partitions: placing needs many documents to choose from."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.coalesce(min(max(1, size // TASK_BYTES), 1 << 30))  # never more than there are


def pack(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 2, id_col: str = "doc_id") -> DataFrame:
    """Pack ``docs`` into sequences of ``size`` tokens and return a row per piece (see :data:`SCHEMA`).

    ``vocabulary`` is a tokenizer's JSON. A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone.
    Long documents are cut. Every id lies in one piece, pieces lie without gaps from offset 0, and each sequence is full
    or a power of two long. ``sequence_id`` is made of the task's number and a count, so a task that runs again gives
    the same. Repeated rows and null ids are packed like others. Other columns play no part. No rows, no pieces.

    Every task places its own rows, so partitions that are small by Spark's estimate are merged to about
    :data:`TASK_BYTES` before. A document is held whole, a few times over, while it is encoded.
    """
    small_batches(docs.sparkSession)
    texts = merged(docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs).alias("text")))
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _caches.setdefault(hash(sent.value), None) or WordCache(sent.value)
        _caches[hash(sent.value)] = cache
        done: list[tuple] = []
        count = [TaskContext.get().partitionId() << 33]
        end = np.asarray([end_id], "<u4").tobytes()

        def close(window: list[Piece]) -> None:
            at = 0
            for doc, start, ids, total in window:
                done.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, count[0], at))
                at += len(ids) // 4
            count[0] += 1

        def rows() -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], names=names)
            done.clear()
            return batch

        packer = LevelPacker(size, close)
        for batch in batches:
            for part in slices(batch):
                for doc, ids in zip(part.column(0).to_pylist(), cache.encode(part.column(1).to_pylist()), strict=True):
                    packer.add(doc, ids + end)
            if len(done) > 10_000:
                yield rows()
        packer.finish()
        if done:
            yield rows()

    return texts.mapInArrow(run, SCHEMA)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())
