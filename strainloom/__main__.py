"""Run registered queries from the command line: python -m strainloom TABLES [QUERY ...] [--out FOLDER] [--list]."""

from __future__ import annotations

import argparse
import importlib
import time
from collections.abc import Callable, Sequence

from strainloom.session import build_session
from strainloom.sources.io import write_delimited, write_summary

MODULES = ("training_data", "network", "diversity", "association", "attribution", "stability", "inference", "details")


def registered() -> dict[str, Callable]:
    """The queries of the core."""
    return {name: q for m in MODULES for name, q in importlib.import_module(f"strainloom.queries.{m}").QUERIES.items()}


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strainloom", description="Run registered queries on a folder of Parquet tables.")
    parser.add_argument("tables", nargs="?", help="folder of the tables")
    parser.add_argument("query", nargs="*", help="names of queries")
    parser.add_argument("--out", help="folder for one TSV folder a query and a summary; without it the first rows are shown")
    parser.add_argument("--list", action="store_true", help="names of the queries")
    args = parser.parse_args(argv)
    queries = registered()
    if args.list:
        print("\n".join(sorted(queries)))
        return 0
    unknown = sorted(set(args.query) - queries.keys())
    if not args.tables or not args.query or unknown:
        parser.error(f"unknown queries: {', '.join(unknown)}" if unknown else "a folder of tables and a query are needed")
    spark, took = build_session(), {}
    for name in args.query:
        began = time.time()
        result = queries[name](spark, args.tables)
        if args.out:
            write_delimited(result, f"{args.out}/{name}", "\t")
        else:
            result.show(20, truncate=False)
        took[name] = round(time.time() - began, 2)
    if args.out:
        write_summary(f"{args.out}/summary.json", tables=args.tables, seconds=took)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
