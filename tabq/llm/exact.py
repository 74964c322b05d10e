"""Exact deduplication against a persistent digest index.

The index is a table of one row per known text, bucketed and sorted by the text's SHA-256. A batch is aggregated to one
row per digest, sort-merge anti-joined with the index (whose side needs no exchange) and what is new is appended.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_path, text_of


class DigestIndex:
    """Digests of all texts seen so far, under ``path``.

    ``buckets`` counts when the index is made; one that exists keeps its own number. A digest has one row: ``digest``
    (binary), ``keep_id`` (the document that stays), ``n`` (rows of the batch that brought it) and ``batch``, that batch's
    name. One writer at a time: a file in the folder names the batch that is being added.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.root = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        there = self.fs.listStatus(self._path(self.root)) if self.fs.exists(self._path(self.root)) else []
        found = [m for s in there if (m := re.fullmatch(r"buckets_(\d+)", s.getPath().getName()))]
        self.buckets = int(found[0][1]) if found else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.location = f"{self.root}/buckets_{self.buckets}"
        self.name = f"tabq_digests_{hashlib.md5(self.location.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, n BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}'"
        )

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def close(self) -> None:
        """Drop the session's table; the index itself stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _writing(self, batch: str) -> None:
        """Take the folder for this batch. A batch that was broken off has it still and may go on; any other is refused."""
        mark = self._path(f"{self.root}/_writing")
        if not self.fs.createNewFile(mark):
            at = self.fs.listStatus(self._path(self.root))
            names = [s.getPath().getName().removeprefix("_batch_") for s in at if s.getPath().getName().startswith("_batch_")]
            if names != [hashlib.md5(batch.encode()).hexdigest()]:
                raise RuntimeError(f"another batch is being added to {self.root!r}; if its writer is gone, add that batch again first")
        self.fs.createNewFile(self._path(f"{self.root}/_batch_{hashlib.md5(batch.encode()).hexdigest()}"))

    def _written(self, batch: str) -> None:
        for name in (f"_batch_{hashlib.md5(batch.encode()).hexdigest()}", "_writing"):
            self.fs.delete(self._path(f"{self.root}/{name}"), False)

    def add(self, docs: DataFrame, text: Column | None = None, id_col: str = "doc_id", batch: str | None = None) -> DataFrame:
        """Decide on every row of ``docs`` and append the texts that are new.

        Returns ``doc_id, keep_id, group_size, kept, text_sha256``, a row per row of ``docs``. Of equal texts in one
        batch the largest ``doc_id`` stays; a text that another batch has brought keeps its earlier ``keep_id``, and none
        of this batch stays. ``group_size`` counts the batch's rows with that text. A null text is an empty one; null
        ids lose against any other, and in a group of null ids alone nothing has an id to keep, so ``keep_id`` is
        null and the rows stay. Rows that repeat an id with the same text all stay or all go. Other columns play
        no part. An empty batch gives an empty result.

        ``batch`` names the batch. Adding one again under its name, after a driver or its answer was lost, appends only
        what is missing and answers as the first time. Without a name every call is a batch of its own. Texts are
        appended when this is called, whether or not the answer is read.
        """
        name = batch if batch is not None else uuid.uuid4().hex
        text = text_of(docs) if text is None else text
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
        mine = cut(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
        self._writing(name)
        fresh = mine.join(self.rows().select("digest"), "digest", "left_anti")
        fresh.select("digest", "keep_id", "n", F.lit(name).alias("batch")).write.insertInto(self.name)
        self._written(name)
        # At most 2 x buckets digests can each have a 2 x buckets-th of all rows: they are looked up without an exchange.
        total = mine.agg(F.sum("n")).first()[0] or 0
        hot = mine.where(F.col("n") >= max(2, total // (2 * self.buckets) + 1)).select("digest", F.col("n").alias("group_size"))
        known = self.rows().select("digest", "keep_id", (F.col("batch") == name).alias("own"))
        hot_known = F.broadcast(hot.join(known, "digest"))
        few = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
        cold = few.join(known, "digest").join(mine.select("digest", F.col("n").alias("group_size")), "digest")
        out = cold.unionByName(rows.join(hot_known, "digest"))
        kept = F.col("own") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, index_path: str | None = None, id_col: str = "doc_id", batch: str | None = None) -> DataFrame:
    """:meth:`DigestIndex.add` on an index at ``index_path``, or on a new one in the shared folder."""
    spark = docs.sparkSession
    return DigestIndex(spark, index_path or shared_path(spark, "digests")).add(docs, id_col=id_col, batch=batch)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
"""
