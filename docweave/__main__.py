"""Command line: list queries, run one over a directory of tables, verify evidence, record a run."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable, Sequence

from docweave.sources import evidence
from docweave.sources.settings import get_settings

PLANS = ("problems", "documents", "extraction", "evaluation", "audits")


def all_queries(modules: Sequence[str] = ()) -> dict[str, Callable]:
    """Every core query by name, and those of further modules that have QUERIES."""
    return {n: q for m in (*(f"docweave.plans.{p}" for p in PLANS), *modules) for n, q in importlib.import_module(m).QUERIES.items()}


def main(arguments: Sequence[str] | None = None) -> int:
    """0 if all is well, 1 if evidence differs, 2 for wrong use."""
    parser = argparse.ArgumentParser(prog="docweave")
    parser.add_argument("--module", action="append", default=[], help="a further module with QUERIES")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run a query and write its result as Parquet")
    run.add_argument("query")
    run.add_argument("--data", default=None)
    run.add_argument("--out", default=None)
    verify = commands.add_parser("verify", help="check evidence files against their index")
    verify.add_argument("folder")
    record = commands.add_parser("record", help="write the record of a parser run")
    record.add_argument("raw_directory")
    record.add_argument("--run", default="{}", help="JSON object with the run's fields")
    given = parser.parse_args(arguments)
    settings = get_settings()
    if given.command == "list":
        print("\n".join(sorted(all_queries(given.module))))
    elif given.command == "verify":
        problems = evidence.verify_evidence(given.folder)
        print("\n".join(f"{name}: {problem}" for name, problem in problems) or "ok")
        return 1 if problems else 0
    elif given.command == "record":
        print(evidence.write_run_record(given.raw_directory, json.loads(given.run)))
    else:
        from pyspark.sql import SparkSession

        from docweave.sources.tables import let_workers_import

        query = all_queries(given.module).get(given.query)
        if query is None:
            print(f"no query {given.query}", file=sys.stderr)
            return 2
        spark = SparkSession.builder.appName("docweave").getOrCreate()
        spark.sparkContext.setLogLevel(settings.log_level)
        if settings.shuffle_partitions:
            spark.conf.set("spark.sql.shuffle.partitions", settings.shuffle_partitions)
        let_workers_import(spark)
        query(spark, given.data or settings.data_dir).write.mode("overwrite").parquet(given.out or f"{settings.output_dir}/{given.query}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
