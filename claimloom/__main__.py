"""python -m claimloom RUN [--groups FILE] [--output FOLDER] [--force] [--json] [--incoming PAPER ...]: analyse a folder of records."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from claimloom.plans.run_state import Run, state_tables
from claimloom.sources import records, sinks


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="claimloom", description="Analyse claims and evidence; print a summary and, with --output, write the run's tables.")
    parser.add_argument("run", help="folder with claims/*.json and evidence/*.json")
    parser.add_argument("--groups", help="registry of comparable evidence, as JSON")
    parser.add_argument("--output", help="folder for the tables")
    parser.add_argument("--force", action="store_true", help="write over an output that exists")
    parser.add_argument("--json", action="store_true", help="write JSON lines instead of Parquet")
    parser.add_argument("--incoming", nargs="*", default=[], help="papers that count as new")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("claimloom").getOrCreate()
    tables = state_tables(Run(records.read_run(spark, args.run, args.groups), args.incoming))
    if args.output:
        sinks.write_run(tables, args.output, args.force, args.json)
    print(json.dumps(tables["summary"].first().asDict(), sort_keys=True))


if __name__ == "__main__":
    main()
