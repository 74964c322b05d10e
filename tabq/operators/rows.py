"""Operators on rows: distinct-on, order, limits and row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_by(value: Column, ascending: bool) -> Column:
    """Null is lowest."""
    return value.asc_nulls_first() if ascending else value.desc_nulls_last()


def distinct_on(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of every value of ``key``; null is a value. Each task keeps a key's first row before the exchange."""
    numbered = df.withColumn("__first", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.where("__first = 1").drop("__first")


def counted(df: DataFrame, order: list[Column] | None) -> DataFrame:
    """``df`` with ``__count``, its rows numbered from 0.

    Rows as they are read are numbered by task, from the counts of the tasks before: one row per task is all that meets. With an
    order, or limits, all rows meet in one task.
    """
    if order is not None:
        return df.withColumn("__count", F.row_number().over(Window.orderBy(*order)) - 1)
    marked = df.withColumn("__id", F.monotonically_increasing_id())
    task = F.shiftright("__id", 33)
    sizes = marked.groupBy(task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__task", before.alias("__start"))
    held = marked.withColumn("__task", task).join(F.broadcast(starts), "__task")  # a row per task
    return held.withColumn("__count", F.col("__start") + F.col("__id") - F.shiftleft("__task", 33)).drop("__id", "__task", "__start")
