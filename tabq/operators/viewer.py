"""What a viewer does with a result, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import ordered_by


def sort_rows(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    return df.orderBy(ordered_by(F.col(f"`{column}`"), ascending))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(f"`{column}`").distinct()


def filter_rows(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Rows whose value, as text, is ``value``, whatever the case; None asks for null."""
    text = F.upper(F.col(f"`{column}`").cast("string"))
    return df.where(text.isNull() if value is None else text == value.upper())


def hide(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)
