"""Where results go: CSV and JSON, to files, folders or standard output."""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Iterator
from typing import TYPE_CHECKING, TextIO

from ..errors import QueryError
from ..functions.types import NAMES

if TYPE_CHECKING:
    from ..engine import Result


def save_path(path: str, number: int = 1, of: int = 1) -> str:
    """``path`` with ``.csv`` at its end, numbered if there are several results; its folder must be there."""
    path = path if path.lower().endswith(".csv") else f"{path}.csv"
    if os.path.isdir(path):
        raise QueryError(f"{path!r} is a folder")
    if not os.path.isdir(os.path.dirname(os.path.abspath(path))):
        raise QueryError(f"the folder of {path!r} does not exist")
    return f"{path[:-4]}-{number}.csv" if of > 1 else path


def _rows(result: Result) -> Iterator[list[str]]:
    """Rows as texts, a partition at a time."""
    for row in result.as_text().toLocalIterator(prefetchPartitions=True):
        yield ["" if x is None else x for x in row]


def write(result: Result, out: TextIO) -> int:
    """CSV with a header; gives the number of rows."""
    writer, n = csv.writer(out, lineterminator="\n"), 0
    writer.writerow(result.names)
    for n, row in enumerate(_rows(result), 1):  # noqa: B007
        writer.writerow(row)
    return n


def save_csv(results: list[Result], path: str) -> list[str]:
    """One file for each result; earlier files are replaced."""
    paths = [save_path(path, i, len(results)) for i in range(1, len(results) + 1)]
    for p, r in zip(paths, results, strict=True):
        with open(p, "w", newline="", encoding="utf-8") as f:
            write(r, f)
    return paths


def save_folders(results: list[Result], path: str) -> list[str]:
    """A folder for each result, numbered if there are several; see :func:`save_folder`."""
    paths = [f"{path.rstrip('/')}-{i}" if len(results) > 1 else path for i in range(1, len(results) + 1)]
    for p, r in zip(paths, results, strict=True):
        save_folder(r, p)
    return paths


def save_folder(result: Result, path: str) -> None:
    """A folder of CSV parts with headers, written by the executors: for results that no single machine should write."""
    result.as_text().toDF(*result.names).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def as_json(results: list[Result], query: str = "") -> str:
    """What a viewer needs: per result its columns, types, number of rows and the rows that are shown, all as texts."""
    from ..engine import DISPLAY_CELLS

    entries = []
    for r in results:
        text = r.as_text().toDF(*[f"v{i}" for i in range(len(r.names))])
        most = max(1, DISPLAY_CELLS // max(1, len(r.names)))
        shown = text.limit(most).collect()
        total = len(shown) if len(shown) < most else r.df.count()
        entries.append({"Query": r.query, "Numrows": total, "Numcols": len(r.names), "Colnames": r.names, "Types": [NAMES[k] for k in r.types], "Vals": [["" if x is None else x for x in row] for row in shown], "Clipped": total > len(shown)})
    return json.dumps({"Entries": entries, "OriginalQuery": query, "Clipped": any(e["Clipped"] for e in entries), "Message": "; ".join(n for r in results for n in r.notes)})
