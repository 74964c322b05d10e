"""Command line: ``python -m tabq -c "select ..."``, or queries on standard input. Results go to standard output as CSV, or to a file."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import Engine, QueryError
from .sources.sinks import as_json, save_csv, save_folders, write


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tabq", description=__doc__)
    parser.add_argument("-c", "--command", help="queries, with semicolons between them; without it they are read from standard input")
    parser.add_argument("-o", "--output", help="a CSV file to write; several results are numbered")
    parser.add_argument("--folder", help="a folder that the executors write CSV parts to, for large results; several are numbered")
    parser.add_argument("--base", help="the folder of the tables", default=None)
    parser.add_argument("--json", action="store_true", help="write JSON to standard output")
    parser.add_argument("--password", help="for encrypt and decrypt")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    text = args.command if args.command is not None else sys.stdin.read()
    try:
        results = Engine(spark, args.base, password=args.password).run(text)
        if args.output:
            print(*save_csv(results, args.output), sep="\n")
        elif args.folder:
            print(*save_folders(results, args.folder), sep="\n")
        elif args.json:
            print(as_json(results, text))
        else:
            for r in results:
                write(r, sys.stdout)
    except QueryError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
