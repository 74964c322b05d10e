"""Tables by path or name: temporary views, registered DataFrames, parquet and CSV files."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import types as t

#: Fixed value: rows of a CSV file from which its types are inferred.
SAMPLE_ROWS = 10_000


@dataclass
class Table:
    """A table with its columns under names of our own, so that joined tables never clash."""

    df: DataFrame
    names: list[str]
    types: list[int]
    raw: bool  # columns are a CSV file's texts, read as a type where they are used
    keys: set[str]
    prefix: str
    size: int | None = None

    def value(self, i: int, kind: int) -> Column:
        """Column ``i`` as a value of a type."""
        col = F.col(f"{self.prefix}{i}")
        if not self.raw:
            return t.converted(native(col, self.types[i]), self.types[i], kind)
        text = F.trim(col)
        text = F.when((text != "") & (F.lower(text) != "null"), text)
        return text if kind in (t.STRING, t.NULL) else t.converted(text, t.STRING, kind)

    @property
    def rowid(self) -> str:
        return f"{self.prefix}row"

    def with_rowid(self) -> Table:
        """A column that rises in the order of the file."""
        here = F.monotonically_increasing_id()
        try:
            order = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), here.alias("i"))
            df = self.df.select("*", order.alias(self.rowid))
        except AnalysisException:  # only files have that metadata
            df = self.df.select("*", here.alias(self.rowid))
        return Table(df, self.names, self.types, self.raw, self.keys, self.prefix, self.size)


def native(col: Column, kind: int) -> Column:
    return col if kind == t.STRING else col.cast(t.SPARK[kind])


class Catalog:
    """Finds tables: registered names first, then temporary views, then files below ``base`` or at the path itself."""

    def __init__(self, spark: SparkSession, base: str | None = None, multiline: bool | None = None):
        self.spark, self.base, self.multiline, self.registered = spark, base, multiline, {}

    def register(self, name: str, df: DataFrame) -> None:
        self.registered[name.lower()] = df

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _file(self, path: str) -> str | None:
        path = os.path.expanduser(path) if path.startswith("~/") else path
        tried = [path]
        if self.base and "/" not in path and "\\" not in path:
            tried = [f"{self.base}/{path}", f"{self.base}/{path}.parquet", f"{self.base}/{path}.csv", path]
        for p in tried:
            if p.endswith((".csv", ".parquet")) and self._exists(p):
                return p
        return None

    def open(self, path: str, header: bool, index: int, alias: str | None) -> Table:
        keys = {alias.lower()} if alias else set()
        prefix = f"t{index}_"
        keys.add(f"_f{index + 1}")
        name = path.lower()
        if name in self.registered or ("/" not in path and "." not in path and self.spark.catalog.tableExists(path)):
            df = self.registered[name] if name in self.registered else self.spark.table(path)
            return self._typed(df, keys | {name}, prefix)
        found = self._file(path)
        if found is None:
            raise QueryError(f"no table or file {path!r}")
        keys.add(os.path.basename(found).rsplit(".", 1)[0].lower())
        if found.endswith(".parquet"):
            return self._typed(self.spark.read.parquet(found), keys, prefix)
        return self._csv(found, header, keys, prefix)

    def _typed(self, df: DataFrame, keys: set[str], prefix: str) -> Table:
        names, kinds = df.columns, [t.of_spark(k) for _, k in df.dtypes]
        nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct", "variant")}
        cols = [F.to_json(F.col(f"`{c}`")) if c in nested else F.col(f"`{c}`") for c in names]
        texts = [c.cast("string") if k == t.STRING else c for c, k in zip(cols, kinds, strict=True)]
        renamed = df.select(*[c.alias(f"{prefix}{i}") for i, c in enumerate(texts)])
        return Table(renamed, names, kinds, False, keys, prefix)

    def _csv(self, path: str, header: bool, keys: set[str], prefix: str) -> Table:
        multiline = self._broken_lines(path) if self.multiline is None else self.multiline
        df = self.spark.read.csv(path, header=False, inferSchema=False, quote='"', escape='"', multiLine=multiline, mode="PERMISSIVE")
        first = df.first()
        if first is None:
            raise QueryError(f"{path!r} is empty")
        width = len(df.columns)
        names = [(x or "").strip() for x in first] if header else [f"col{i + 1}" for i in range(width)]
        schema = ", ".join(f"{prefix}{i} string" for i in range(width))
        df = self.spark.read.csv(path, header=header, schema=schema, quote='"', escape='"', multiLine=multiline, mode="PERMISSIVE", enforceSchema=True)
        kinds = [t.NULL] * width
        for row in df.limit(SAMPLE_ROWS).collect():
            kinds = [max(k, t.infer(x)) for k, x in zip(kinds, row, strict=True)]
        return Table(df, names, kinds, True, keys, prefix)

    def _broken_lines(self, path: str) -> bool:
        """Whether a line of a CSV file ends inside quotes. Only then must the file be read in one piece; any other is split among
        tasks. All lines are looked at, up to the first such one."""
        marks = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        return not self.spark.read.text(path).where(marks % 2 == 1).isEmpty()

    def list(self, folder: str) -> tuple[list[str], list[str]]:
        """Sub-folders and CSV or parquet files of a folder; names with a leading dot are left out."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)
        names = sorted((s.getPath().getName(), s.isDirectory()) for s in found)
        shown = [(n, d) for n, d in names if not n.startswith(".")]
        tables = [n for n, _ in shown if n.endswith((".csv", ".parquet"))]
        return [n for n, d in shown if d and n not in tables], tables


def size_of(df: DataFrame) -> int:
    """A plan's size in bytes, as Catalyst estimates it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
