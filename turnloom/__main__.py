"""Commands: ``python -m turnloom`` or ``spark-submit``; a session's settings come from where it is submitted."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog
from .sources import configs


def _shown(df: DataFrame) -> None:
    """Tables about configurations, which are as small as their folder, a row a line."""
    for r in df.collect():
        print(*("" if v is None else "; ".join(v) if isinstance(v, list) else v for v in r), sep="\t")


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="turnloom")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="write a query's rows as Parquet")
    explain = sub.add_parser("explain", help="a query's plan")
    sql = sub.add_parser("sql", help="a query's SQL")
    for p in (run, explain, sql):
        p.add_argument("query", choices=sorted(catalog.queries()), metavar="query")
    for p in (run, explain):
        p.add_argument("tables", help="folder of the tables")
    run.add_argument("out")
    run.add_argument("--mode", default="errorifexists", choices=("errorifexists", "overwrite", "append"))
    checked = sub.add_parser("configs", help="stage, strategy, output and problems of configurations")
    ahead = sub.add_parser("preflight", help="inputs that configurations name and that are missing")
    for p in (checked, ahead):
        p.add_argument("folder")
    ahead.add_argument("--root", action="append", default=[], metavar="NAME=FOLDER", help="where paths beginning with NAME lie; data is needed")
    a = parser.parse_args(argv)
    roots = dict(r.split("=", 1) for r in getattr(a, "root", []) if "=" in r)
    if a.command == "preflight" and "data" not in roots:
        parser.error("preflight needs --root data=FOLDER")
    if a.command == "list":
        print(*sorted(catalog.queries()), sep="\n")
    elif a.command == "sql":
        print(catalog.oracle_sql().get(a.query, f"{a.query} has no SQL"))
    else:
        spark = SparkSession.builder.appName("turnloom").getOrCreate()
        if a.command == "run":
            catalog.queries()[a.query](spark, a.tables).write.mode(a.mode).parquet(a.out)
        elif a.command == "explain":
            catalog.queries()[a.query](spark, a.tables).explain("formatted")
        else:
            _shown(configs.config_table(spark, a.folder) if a.command == "configs" else configs.preflight(spark, a.folder, roots))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
