"""A query engine for tabular files: a small, forgiving SQL dialect planned onto Spark DataFrames."""

from .engine import Engine, Result
from .errors import QueryError

__all__ = ["Engine", "QueryError", "Result"]
