"""What the operators of this subpackage share: shared folders, checked joins, word counting."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a longest run of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: The most rows that are sent to every executor by :func:`join_small`.
BROADCAST_ROWS = 100_000


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. A local session without it gets a folder of its own; on a
    cluster that would be a folder of the driver's, which executors cannot see, so there it must be set."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tabq-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: later steps neither recompute it nor lose it with an executor."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that :func:`cut` has made needless: it does when the driver collects garbage, which
    a job of many rounds would otherwise not come to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_root(spark)}/tabq-{kind}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Let Python see 1,000 rows at a time, unless the session says otherwise: texts are long, and a batch is held several
    times over, in the executor and in its worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def null_key(value: Column) -> Column:
    """A key that is never null, orders null last and keeps all values apart."""
    return F.when(value.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), value.cast("string")))


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salt: Column | None = None, copies: int = 64) -> DataFrame:
    """``big`` joined with a table of one row per key, without gathering a frequent key in one task.

    ``small`` must be cheap to count (written by :func:`cut`). With :data:`BROADCAST_ROWS` rows at most it is sent to
    every executor. Beyond that, each key is dealt over ``copies`` partitions: ``big`` by ``salt`` (a column that
    spreads its rows), ``small`` in as many copies.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(salt if salt is not None else F.monotonically_increasing_id()), F.lit(copies)).cast("int"))
    dealt = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return salted.join(dealt, [*keys, "__salt"], how).drop("__salt")
