"""Language-model scoring by cross-entropy difference.

A target model is counted on the documents marked as wanted, a background model on all documents. Both are bigram models
with the same vocabulary, smoothing and contexts. A document's score is the mean, over its words, of the background's
loss less the target's: high where the text is more like the wanted ones than like the rest. What a document itself
adds to either model is taken out before it is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, MESSAGE, REPLY, answers, bucket_of, buckets_for, gaps, packed, replied, sent, unpacked
from .common import table, text_of, word_count
from .hashing import mix, owners, words

#: Words that all documents have fewer times are one unknown word to both models.
MIN_COUNT = 3
#: Weight, in words, of the next simpler model: bigrams fall back to single words, words to :data:`FLOOR`.
BACKOFF, FLOOR_WEIGHT, FLOOR = 8.0, 1.0, 1e-6
_UNKNOWN, _BEGIN = np.uint64(1), np.uint64(2)


def _entries(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, how often they come, how often among wanted words, and where each one is."""
    h, inverse = np.unique(hashes, return_inverse=True)
    return h, np.bincount(inverse, minlength=len(h)).astype(np.uint32), np.bincount(inverse[wanted], minlength=len(h)).astype(np.uint32), inverse


def _message(block: int, h: np.ndarray, n: np.ndarray, t: np.ndarray, buckets: int) -> pa.Table:
    return sent(bucket_of(h << np.uint64(16), buckets), buckets, block, lambda x, y: packed(gaps(h[x:y]), n[x:y], t[x:y]))


def _totals(kind: int, least: int):
    """Adds up every hash of a bucket and answers each block with the totals of its own: of words, those that come ``least``
    times or more, with their hashes; of pairs all, in the order in which the block has sent them."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        owner = rows.column("block").to_pylist()
        got = [unpacked(p, np.uint64, np.uint32, np.uint32) for p in rows.column("payload").to_pylist()]
        each = [np.cumsum(g[0], dtype=np.uint64) for g in got]
        h, inverse = np.unique(np.concatenate(each), return_inverse=True)
        n, t = (np.bincount(inverse, weights=np.concatenate([g[i] for g in got]).astype(float)).astype(np.int64) for i in (1, 2))
        cuts, out = np.cumsum([0, *[len(x) for x in each]]), []
        for b, x, a, e in zip(owner, each, cuts[:-1], cuts[1:], strict=True):
            mine = inverse[a:e]
            if kind == 2:
                out.append((b, bytes([kind]) + packed(np.array([key[0].as_py()]), n[mine], t[mine])))
                continue
            hit = n[mine] >= least
            out.append((b, bytes([kind]) + packed(gaps(x[hit]), n[mine[hit]], t[mine[hit]])))
        return replied(out)

    return run


def _filled(payloads: list[bytes], h: np.ndarray, buckets: int) -> list[np.ndarray]:
    """The totals of a block's pairs, which are ``h``."""
    out = [np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)]
    cuts = np.searchsorted(bucket_of(h << np.uint64(16), buckets), np.arange(buckets + 1))
    for p in payloads:
        if p[0] == 2:
            at, n, t = unpacked(p[1:], np.int64, np.int64, np.int64)
            out[0][cuts[at[0]] : cuts[at[0] + 1]], out[1][cuts[at[0]] : cuts[at[0] + 1]] = n, t
    return out


def _read(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = [unpacked(p[1:], np.uint64, np.int64, np.int64) for p in payloads if p[0] == 1]
    h = np.concatenate([np.zeros(0, np.uint64), *[np.cumsum(g[0], dtype=np.uint64) for g in got]])
    order = np.argsort(h)
    return h[order], *[np.concatenate([np.zeros(0, np.int64), *[g[i] for g in got]])[order] for i in (1, 2)]


class _Tokens:
    """A block's words as hashes of 48 bits, and which of them are in wanted documents."""

    def __init__(self, rows: pa.RecordBatch, payloads: list[bytes]):
        w = words(rows.column("text"), lower=True)
        self.first, self.hash = w.first, (w.hashes >> np.uint64(16)) | np.uint64(4)
        self.owner = owners(w.first)
        ids = [np.frombuffer(p, np.int64, offset=1) for p in payloads if p[0] == 0]
        mark = pc.is_in(rows.column("doc_id"), value_set=pa.array(np.concatenate([np.zeros(0, np.int64), *ids])))
        self.wanted_doc = pc.fill_null(mark, False).to_numpy(zero_copy_only=False)
        self.wanted = self.wanted_doc[self.owner]

    def known(self, vocabulary: np.ndarray) -> np.ndarray:
        """Words outside the vocabulary as the unknown word."""
        at = np.minimum(np.searchsorted(vocabulary, self.hash), max(0, len(vocabulary) - 1))
        return np.where(vocabulary[at] == self.hash, self.hash, _UNKNOWN) if len(vocabulary) else np.full(len(self.hash), _UNKNOWN)

    def pairs(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's context, and the hash of context and word."""
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[self.first[:-1][np.diff(self.first) > 0]] = _BEGIN
        return before, (mix(before * np.uint64(0xD6E8FEB86659FD93) + mix(word)) >> np.uint64(16)) | np.uint64(4)

    def counted(self, word: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All that is counted with the pairs: these, the unknown word, and how many texts begin; and which are wanted."""
        odd, begins = word == _UNKNOWN, self.first[:-1][np.diff(self.first) > 0]
        h = np.concatenate([pair, word[odd], np.full(len(begins), _BEGIN)])
        return h, np.concatenate([self.wanted, self.wanted[odd], self.wanted[begins]])


def cross_entropy_difference(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, n_words, loss_target, loss_background, score`` for every row of ``docs (doc_id, text)``.

    ``wanted (doc_id)`` says which documents the target model is counted on. All documents count for the background model
    and the vocabulary; words are lower-cased (A-Z). Losses are mean natural logs per word; a text without words has none
    (null). A null id is never wanted, and such rows are dealt out by their text; repeated rows count each time. Other columns play no part, no rows give none.
    """
    text, doc_id = text_of(docs), docs["doc_id"].cast("long")
    counted = docs.select(doc_id.alias("doc_id"), F.octet_length(text).alias("size"), word_count(text).alias("n"))
    ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    row = counted.join(ids.withColumn("w", F.lit(1)), "doc_id", "left").agg(F.sum("size"), F.sum("n"), F.sum(F.col("n") * F.coalesce("w", F.lit(0)))).first()
    size, total, target = (x or 0 for x in row)
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks)).cast("int").alias("block")
    blocks = docs.select(block(F.coalesce(doc_id, F.xxhash64(text))), doc_id.alias("doc_id"), text.alias("text"))

    def listed(key: tuple, rows: pa.Table) -> pa.Table:
        return replied([(key[0].as_py(), bytes([0]) + np.sort(rows.column("doc_id").to_numpy()).tobytes())])

    marks = ids.select(block(F.col("doc_id")), "doc_id").groupBy("block").applyInArrow(listed, REPLY)
    n_words, n_pairs = buckets_for(size / 60), buckets_for(size / 10)

    def ask_words(b: int, rows: pa.RecordBatch, payloads: list[bytes]) -> pa.Table:
        t = _Tokens(rows, payloads)
        return _message(b, *_entries(t.hash, t.wanted)[:3], n_words)

    def ask_pairs(b: int, rows: pa.RecordBatch, payloads: list[bytes]) -> pa.Table:
        t = _Tokens(rows, payloads)
        word = t.known(_read(payloads)[0])
        return _message(b, *_entries(*t.counted(word, t.pairs(word)[1]))[:3], n_pairs)

    def score(b: int, rows: pa.RecordBatch, payloads: list[bytes]) -> pa.Table:
        t = _Tokens(rows, payloads)
        vocabulary, *singles = _read(payloads)
        word = t.known(vocabulary)
        before, pair = t.pairs(word)
        known_pairs = np.unique(t.counted(word, pair)[0])
        doubles = _filled(payloads, known_pairs, n_pairs)
        n = np.diff(t.first)

        def own(values: np.ndarray) -> np.ndarray:
            """How often each word's document has it."""
            order = np.lexsort((values, t.owner))
            v, o = values[order], t.owner[order]
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
            runs = np.diff(np.append(np.flatnonzero(new), len(v)))
            out = np.empty(len(v), np.int64)
            out[order] = np.repeat(runs, runs)
            return out

        def found(keys: np.ndarray, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(values), np.int64)
            at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
            return np.where(keys[at] == values, counts[at], 0)

        def single(which: int, values: np.ndarray) -> np.ndarray:
            c = found(vocabulary, singles[which], values)
            for x in (_UNKNOWN, _BEGIN):
                c[values == x] = found(known_pairs, doubles[which], np.array([x]))[0]
            return c

        own_word, own_pair = own(word), own(pair)
        own_before = np.zeros(len(word), np.int64)
        own_before[1:] = own_word[:-1]
        own_before[before == _BEGIN] = 1
        losses = []
        for which, all_ in ((0, total), (1, target)):
            less = np.ones(len(word)) if which == 0 else t.wanted.astype(float)  # what the document itself has added
            one = (single(which, word) - own_word * less + FLOOR_WEIGHT * FLOOR) / (np.maximum(all_ - n[t.owner] * less, 0) + FLOOR_WEIGHT)
            p = (found(known_pairs, doubles[which], pair) - own_pair * less + BACKOFF * one) / (single(which, before) - own_before * less + BACKOFF)
            each = -np.log(np.maximum(p, 1e-12))
            sums = np.append(0.0, np.cumsum(each))
            losses.append((sums[t.first[1:]] - sums[t.first[:-1]]) / np.maximum(n, 1))
        none = n == 0
        target_loss, background = (pa.array(x, pa.float64(), mask=none) for x in losses[::-1])
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(n, pa.int64()), "loss_target": target_loss, "loss_background": background, "score": pa.array(losses[0] - losses[1], pa.float64(), mask=none)})

    word_totals = answers(blocks, marks, ask_words, MESSAGE).groupBy("bucket").applyInArrow(_totals(1, MIN_COUNT), REPLY)
    pair_totals = answers(blocks, word_totals.unionByName(marks), ask_pairs, MESSAGE).groupBy("bucket").applyInArrow(_totals(2, 1), REPLY)
    return answers(blocks, pair_totals.unionByName(word_totals).unionByName(marks), score, "doc_id long, n_words long, loss_target double, loss_background double, score double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target model is counted on the documents labelled good and not toxic."""
    wanted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), wanted)
