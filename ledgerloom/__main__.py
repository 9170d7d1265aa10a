"""``python -m ledgerloom list | run QUERY DATA OUT | explain QUERY DATA | tables DATA | sql DATA STATEMENT``."""

from __future__ import annotations

import argparse
from importlib import import_module
from importlib.util import find_spec

from pyspark.sql import SparkSession

from . import catalog
from .plans.serving import run_sql
from .sinks import replaced
from .sources.discovery import tables_in
from .sources.files import parquet_views


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    parser.add_argument("action", choices=["list", "run", "explain", "tables", "sql"])
    parser.add_argument("rest", nargs="*")
    given = parser.parse_args(args)
    queries = dict(catalog.QUERIES)
    extra = f"{__package__}.llm"
    if find_spec(extra):
        queries |= import_module(f"{extra}.queries").QUERIES
    if given.action == "list":
        print("\n".join(sorted(queries)))
        return
    spark = SparkSession.builder.appName("ledgerloom").getOrCreate()
    match given.action, given.rest:
        case "run", [name, data, out]:
            replaced(queries[name](spark, data), out)
        case "explain", [name, data]:
            queries[name](spark, data).explain("formatted")
        case "tables", [data]:
            tables_in(spark, data).show(1000, False)
        case "sql", [data, statement]:
            parquet_views(spark, data, [r.table_name for r in tables_in(spark, data).collect()])
            run_sql(spark, statement).show(1000, False)
        case _:
            parser.error("see the usage")


if __name__ == "__main__":
    main()
