"""Command line of the census warehouse.

    python -m sparkwright.cli SOURCE --db DIR [--reset] [--summary] [--checks] [--report FILE] [-v]

Exit codes: 0 done, 1 a check or a load failed, 2 the source is missing or not given.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from sparkwright.plans.census import Census
from sparkwright.session import session
from sparkwright.sources.files import Files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkwright")
    parser.add_argument("source", nargs="?", help="a CSV file, or a folder of them")
    parser.add_argument("--db", default="warehouse", help="folder of the warehouse")
    parser.add_argument("--reset", action="store_true", help="remove all tables first")
    parser.add_argument("--summary", action="store_true", help="print runs and table sizes")
    parser.add_argument("--checks", action="store_true", help="run the quality checks; exit 1 if one fails")
    parser.add_argument("--report", help="write the serving table as a page")
    parser.add_argument("-v", "--verbose", action="store_true", help="say what is done, and show refused rows")
    args = parser.parse_args(argv)
    say = lambda text: print(text, file=sys.stderr) if args.verbose else None
    if not (args.source or args.summary or args.checks or args.report or args.reset):
        parser.print_usage(sys.stderr)
        return 2
    spark = SparkSession.getActiveSession() or session("sparkwright-cli")
    if args.source and not Files(spark, args.source).exists(args.source):
        print(f"no such file or folder: {args.source}", file=sys.stderr)
        return 2
    census = Census(spark, args.db)
    if args.reset:
        census.store.reset()
    census.create()
    try:
        for run in census.ingest(args.source) if args.source else []:
            print(" ".join(f"{k}={v}" for k, v in run.items()))
            say(f"run {run['load_run_id']} is done")
    except Exception as e:
        print(f"load failed: {e}", file=sys.stderr)
        return 1
    if args.source and args.verbose:
        census.reject_report().show(truncate=False)
    if args.summary:
        census.runs().show(truncate=False)
        census.store.counts().show(truncate=False)
    if args.report:
        with open(args.report, "w") as f:
            f.write(census.page())
        say(f"wrote {args.report}")
    if args.checks:
        verdicts, passed = census.check_quality()
        verdicts.show(100, truncate=False)
        return 0 if passed else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
