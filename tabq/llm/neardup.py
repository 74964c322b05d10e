"""Near-duplicate documents: MinHash signatures joined by a multi-index over the Hamming distance.

A signature is :data:`CHUNKS` x :data:`PER_CHUNK` symbols of 16 bits. Two signatures that differ in at most
:data:`DISTANCE` symbols differ, by pigeonhole, in at most one symbol of some chunk: with that symbol left out, the
chunk is the same in both. So each chunk gives one key per symbol left out, and documents that share a key are
candidates. The candidates' clusters are then compared on full shingle sets, so every link that counts is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_small, small_batches, table
from .graph import components
from .hashing import mix, owners, ranges, slices, words

CHUNKS, PER_CHUNK = 16, 5
#: The signature distance up to which all pairs are found: less than 2 to a chunk. At a similarity of 0.8, two
#: signatures of 80 symbols differ in 16 on average and in over 31 once in some 30,000 times.
DISTANCE = 2 * CHUNKS - 1
SYMBOLS = CHUNKS * PER_CHUNK
#: Sets that one task compares with each other at once.
BLOCK = 2000
#: Members of a cluster's main component against which its other blocks are tried first.
PIVOTS = 32

_rng = np.random.Generator(np.random.PCG64(20_240_229))
_MULTIPLY = (_rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within it, and where each text's begin.

    A text with fewer words than a shingle has, has all its words as its only one; without words it has none.
    """
    w = words(texts, lower=True)
    n = np.diff(w.first)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    at = ranges(w.first[:-1], count)
    owner = np.repeat(np.arange(len(n)), count)
    h = np.zeros(len(at), np.uint64)
    for k in range(shingle):
        inside = at + k < w.first[owner + 1]
        h[inside] = mix(h[inside] * np.uint64(0xD6E8FEB86659FD93) + w.hashes[at[inside] + k] + np.uint64(k + 1))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(n) + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of symbols for each non-empty set."""
    at = first[:-1][np.diff(first) > 0]
    out = np.zeros((len(at), SYMBOLS), np.uint16)
    if len(at):
        x = (h >> np.uint64(32)).astype(np.uint32)
        for k in range(SYMBOLS):
            least = np.minimum.reduceat(x * _MULTIPLY[k] + _ADD[k], at)
            out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """The keys of each signature: one for each symbol left out of its chunk."""
    s = signature.astype(np.uint64) + np.uint64(1)
    out = np.zeros((len(s), SYMBOLS), np.uint64)
    for c in range(CHUNKS):
        for skip in range(PER_CHUNK):
            key = np.full(len(s), c * PER_CHUNK + skip + 1, np.uint64)
            for j in range(PER_CHUNK):
                if j != skip:
                    key = mix(key * np.uint64(0xD6E8FEB86659FD93) + s[:, c * PER_CHUNK + j])
            out[:, c * PER_CHUNK + skip] = key
    return out.view(np.int64)


def described(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n_shingles, digest`` (of the shingle set) and ``signature``, both null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, first = shingle_sets(part.column("text"), shingle)
                n = np.diff(first)
                sig = iter(signatures(h, first))
                digest = [hashlib.md5(h[a:b].tobytes()).digest() if b > a else None for a, b in zip(first[:-1], first[1:], strict=True)]
                sigs = [next(sig).tobytes() if k else None for k in n]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "digest", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def _stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and node; for each entry the least node of its key."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return key, node, node[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))] if len(key) else node


def candidates(nodes: DataFrame) -> DataFrame:
    """Edges ``a, b`` that join all of ``nodes (doc_id, signature)`` that share a key: each key's nodes with its least.

    Every task first joins its own nodes, so a key reaches the exchange once a task at most, however many share it.
    """

    def keyed(batches: Iterator[pa.RecordBatch], local: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column(0).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            key, who, least = _stars(chunk_keys(sig).ravel(), np.repeat(node, SYMBOLS))
            pick = who != least if local else who == least
            got = np.unique(np.stack([least[pick], who[pick]]), axis=1) if local else np.stack([key[pick], who[pick]])
            yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64())], names=["a", "b"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            _, who, least = _stars(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]))
            pair = np.unique(np.stack([least, who])[:, who != least], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0], pa.int64()), pa.array(pair[1], pa.int64())], names=["a", "b"])

    near = nodes.mapInArrow(lambda x: keyed(x, True), "a long, b long")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    far = nodes.mapInArrow(lambda x: keyed(x, False), "a long, b long").repartition(n, "a").mapInArrow(joined, "a long, b long")
    return near.unionByName(far).distinct()


class Sets:
    """Sets of one block, with the inverted index that counts how much a set shares with each of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        self.known, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        self.holder = np.repeat(np.arange(len(sets)), self.size)[order]
        self.first = np.searchsorted(inverse[order], np.arange(len(self.known) + 1))

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Which sets are similar to ``s`` by ``percent`` or more: 100 * intersection >= percent * union."""
        at = np.searchsorted(self.known, s)
        at = at[at < len(self.known)] if len(at) and at[-1] == len(self.known) else at
        at = at[self.known[at] == s[: len(at)]]
        posts = self.holder[ranges(self.first[at], self.first[at + 1] - self.first[at])]
        inter = np.bincount(posts, minlength=len(self.size))
        return np.flatnonzero(100 * inter >= percent * (len(s) + self.size - inter))


def links_within(nodes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that give the sets' components. What is in the first set's component need not be asked again: of two sets
    in different components one at least is asked, and is compared with all."""
    index, root = Sets(sets), list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in range(len(sets)):
        if i and find(i) == find(0):
            continue
        for j in index.linked(sets[i], percent):
            if (a := find(i)) != (b := find(int(j))):
                root[max(a, b)] = min(a, b)
                out.append((nodes[i], nodes[int(j)]))
    return out


def links_to(nodes: list[int], sets: list[np.ndarray], asks: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between ``asks`` and the block's nodes, as many as give the components of all such links: fewer than there
    are nodes, though one set may be similar to all of a block."""
    index, main, out = Sets(sets), np.arange(len(nodes)), []
    for x, s in asks:
        held = index.linked(s, percent)
        if len(held):
            roots = np.unique(main[held])
            out.append((x, nodes[int(roots[0])]))
            out += [(x, nodes[int(r)]) for r in roots[1:]]
            main[np.isin(main, roots)] = roots[0]
    return out


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray], Iterator[tuple[int, np.ndarray]]]]:
    """Rows ``cluster, block, asks, node, shingles`` in that order: a block's nodes and sets, then those to ask for."""
    rows = ((c, k, q, n, np.frombuffer(s, np.uint64)) for b in batches for c, k, q, n, s in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True))
    at, nodes, sets, asks = None, [], [], []
    for c, k, q, n, s in rows:
        if at != (c, k):
            if nodes:
                yield nodes, sets, asks
            at, nodes, sets, asks = (c, k), [], [], []
        if q:
            asks.append((n, s))
            if len(asks) >= BLOCK:
                yield nodes, sets, asks
                asks = []
        else:
            nodes.append(n)
            sets.append(s)
    if nodes:
        yield nodes, sets, asks


def exact_links(members: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that give the components of each cluster of ``members (cluster, block, node, shingles)``.

    Blocks are compared within themselves. In a cluster of several blocks, all are then tried against some members of the
    main component so far, and what is still outside it against every block.
    """
    spark = members.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(rows: DataFrame) -> DataFrame:
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for nodes, sets, asks in _by_block(batches):
                if asks:
                    out = links_to(nodes, sets, asks, percent)
                else:
                    out = links_within(nodes, sets, percent)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

        dealt = rows.repartition(n, "cluster", "block").sortWithinPartitions("cluster", "block", "asks", "node")
        return dealt.select("cluster", "block", "asks", "node", "shingles").mapInArrow(found, "a long, b long")

    links = cut(run(members.withColumn("asks", F.lit(0))))
    large = cut(members.where("blocks > 1"))
    if large.isEmpty():
        return links
    for pivots in (True, False):
        roots = components(links)
        held = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        sizes = held.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
        main = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
        marked = join_small(held, cut(main), ["cluster"], salt=F.col("node"))
        if pivots:
            first = marked.where("root = main AND block = 0").select("cluster", "node", "shingles", "blocks")
            asked = cut(first.withColumn("k", F.row_number().over(_least_first())).where(F.col("k") <= PIVOTS).drop("k"))
        else:
            asked = cut(marked.where("root <> main").select("cluster", "node", "shingles", "blocks"))
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(1))
        cols = ["cluster", "block", "asks", "node", "shingles"]
        links = cut(links.unionByName(run(large.withColumn("asks", F.lit(0)).select(cols).unionByName(asked.select(cols))).where("a <> b").distinct()))
    return links


def _least_first():
    from pyspark.sql import Window

    return Window.partitionBy("cluster").orderBy(F.xxhash64("node"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text)``.

    Words are lower-cased (A-Z only). A document is its set of distinct ``shingle``-word shingles; with fewer words its
    whole sequence is the only one; without words or text the set is empty and linked with nothing. Two documents are
    linked when their sets' similarity is ``percent`` or more. ``component_id`` is the smallest doc_id that can be
    reached, ``kept`` says whether that is the document itself. Equal sets are one node from the start. Rows that repeat an id
    are one document, linked with whatever any of their texts is similar to; rows with a null id are linked with nothing and kept. Other columns play no part, no rows give none.
    """
    small_batches(docs.sparkSession)
    all_ = cut(described(docs, shingle))
    full = all_.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    nodes = cut(full.join(classes, "digest").where("doc_id = rep").dropDuplicates(["doc_id", "digest"]).select("doc_id", "signature"))
    clusters = components(candidates(nodes))
    sizes = clusters.groupBy(F.col("root").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    sizes = cut(sizes.select("cluster", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    placed = join_small(clusters.select("node", F.col("root").alias("cluster")), sizes, ["cluster"], salt=F.col("node"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, first = shingle_sets(part.column("text"), shingle)
                rows = [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(4)], pa.array(rows, pa.binary())], names=["node", "cluster", "blocks", "block", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    members = texts.join(placed, "node").select("node", "cluster", "blocks", "block", "text").mapInArrow(sets, "node long, cluster long, blocks int, block int, shingles binary")
    links = exact_links(cut(members), percent)
    several = cut(full.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id"))
    if not several.isEmpty():  # an id with several texts links their classes
        reps = full.select("doc_id", "digest").join(several, "doc_id").join(classes, "digest").select("doc_id", "rep").distinct()
        least = reps.groupBy("doc_id").agg(F.min("rep").alias("a"))
        links = links.unionByName(reps.join(least, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b"))
    roots = components(links)
    # Each class goes to its root, each document to its class.
    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root"))
    spread = _classes_of(full.select("doc_id", "n_shingles", "digest"), cut(named))
    alone = all_.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("root"))
    out = spread.select("doc_id", "n_shingles", "root").unionByName(alone)
    return out.select("doc_id", "n_shingles", F.col("root").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("root"), F.lit(True)).alias("kept"))


def _classes_of(full: DataFrame, named: DataFrame) -> DataFrame:
    """``full`` joined with ``named`` by digest. Digests that a hundredth of a partition's share of rows have or more are few
    (their number is bounded by the shares) and are looked up without an exchange."""
    n = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = full.count()
    hot = full.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1, total // (4 * n))).select("digest")
    hot = cut(hot)  # fewer than 4 x partitions rows
    cold = full.join(F.broadcast(hot), "digest", "left_anti").join(named, "digest")
    return cold.unionByName(full.join(F.broadcast(hot.join(named, "digest")), "digest"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
linked AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
           GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT y, root FROM reach JOIN linked ON x = doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root) AS component_id, min(root) = doc_id AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""
