"""python -m quillframe [-f table|json|jsonl|csv|markdown] [-v name=value] [-e SQL | FILE] DIR...

Tables are the *.parquet entries of the folders.  Exit code 1 where a statement fails.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from quillframe.errors import EngineError
from quillframe.plans.session import Result, Session
from quillframe.sources.catalog import Catalog
from quillframe.sources.files import cell, csv_lines, jsonl, markdown


def shown(df: DataFrame, how: str) -> str:
    if how == "csv":
        return "".join(csv_lines(df))
    if how == "jsonl":
        return "\n".join(jsonl(df))
    if how == "json":
        return "[" + ",\n".join(jsonl(df)) + "]"
    if how == "markdown":
        return markdown(df)
    rows = [[cell(v) for v in r] for r in df.toLocalIterator()]
    width = [max(map(len, col)) for col in zip(df.columns, *rows, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in [df.columns, ["-" * w for w in width], *rows])


def envelope(results: list[Result]) -> str:
    """One JSON object for a whole script."""
    return json.dumps([{"kind": r.kind, "report": r.report, "rows": [json.loads(x) for x in jsonl(r.frame)] if r.frame is not None else None} for r in results], ensure_ascii=False, default=str)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillframe", description=__doc__)
    p.add_argument("-f", "--format", choices=["table", "json", "jsonl", "csv", "markdown", "envelope"], default="table")
    p.add_argument("-v", "--var", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("-e", "--execute", metavar="SQL")
    p.add_argument("paths", nargs="+", help="a script (without -e), then folders of Parquet tables")
    a = p.parse_args(argv)
    paths = list(a.paths)
    if a.execute:
        sql = a.execute
    else:
        with open(paths.pop(0), encoding="utf-8") as f:
            sql = f.read()
    spark = SparkSession.builder.getOrCreate()
    catalog = Catalog(spark)
    for folder in paths:
        for name in sorted(os.listdir(folder)):
            if name.endswith(".parquet"):
                catalog.add(name.removesuffix(".parquet"), os.path.join(folder, name))
    session = Session(spark, catalog, variables=dict(v.split("=", 1) for v in a.var))
    try:
        results = session.run(sql)
        if a.format == "envelope":
            print(envelope(results))
        else:
            for r in results:
                if r.frame is not None:
                    print(shown(r.frame, a.format))
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    for w in session.warnings:
        print(f"warning: {w}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
