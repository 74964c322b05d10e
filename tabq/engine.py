"""The engine: query text in, DataFrames out."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import QueryError
from .functions import types as t
from .functions.expressions import Switches
from .plans.lexer import split_queries
from .plans.parser import parse
from .plans.planner import Planner
from .sources.catalog import Catalog

#: Fixed value: a result shows so many cells at most; its rows are all counted and saved.
DISPLAY_CELLS = 20_000


@dataclass
class Result:
    """One query's rows, lazily: ``df`` has the columns ``names`` of types ``types`` (numbers of ``functions.types``)."""

    query: str
    df: DataFrame
    names: list[str]
    types: list[int]
    notes: list[str] = field(default_factory=list)

    def as_text(self) -> DataFrame:
        """All values as texts; null stays null. Columns are named by position, as names may repeat."""
        held = self.df.toDF(*[f"v{i}" for i in range(len(self.names))])
        return held.select(*[t.shown(F.col(f"v{i}"), k).alias(f"v{i}") for i, k in enumerate(self.types)])

    def display(self) -> DataFrame:
        """The first rows, as many as a viewer shows."""
        return self.df.limit(max(1, DISPLAY_CELLS // max(1, len(self.names))))


class Engine:
    """Runs queries over the tables of ``base`` (a folder of parquet or CSV files), views and registered DataFrames.

    Switches: ``between_inclusive``, ``left_assoc`` (arithmetic groups to the left), ``like_regex`` (other marks of regular
    expressions are live in patterns; on unless switched off) and ``password`` for encrypt and decrypt. ``multiline`` says whether
    quoted cells of CSV files hold line ends; without it the files' lines are looked at.
    """

    def __init__(self, spark: SparkSession, base: str | None = None, multiline: bool | None = None, **switches):
        self.spark, self.catalog, self.switches = spark, Catalog(spark, base, multiline), Switches(**switches)
        self.history: list[str] = []
        self.tag = f"tabq-{uuid.uuid4().hex}"

    def register(self, name: str, df: DataFrame) -> None:
        self.catalog.register(name, df)

    def query(self, text: str) -> Result:
        parsed = parse(text, self.switches.left_assoc)
        planned = Planner(parsed, self.catalog, self.switches).plan()
        self.history.append(text)
        return Result(text, planned.df, planned.names, planned.types, planned.notes)

    def sql(self, text: str) -> DataFrame:
        return self.query(text).df

    def run(self, text: str) -> list[Result]:
        """Several queries between semicolons; the first that is wrong ends it and says which it is."""
        out = []
        for n, one in enumerate(split_queries(text), 1):
            try:
                out.append(self.query(one))
            except QueryError as e:
                raise QueryError(f"query {n}: {e}") from e
        return out

    def explain(self, text: str) -> None:
        self.sql(text).explain("formatted")

    def collect(self, text: str) -> list:
        """Rows of a query whose jobs :meth:`cancel` can end from another thread."""
        self.spark.addTag(self.tag)
        try:
            return self.sql(text).collect()
        finally:
            self.spark.removeTag(self.tag)

    def cancel(self) -> None:
        self.spark.interruptTag(self.tag)
