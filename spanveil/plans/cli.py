"""python -m spanveil.plans.cli: scores a suite. Exit 0: fine; 1: a gate failed, or it regressed and --fail-on-regression is set; 2: bad use."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from ..operators.errors import GuardError
from ..operators.guard import Guard
from ..sources import suites
from . import gates, reports

KEY = "evaluation"


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    parser = argparse.ArgumentParser(prog="spanveil-eval")
    parser.add_argument("suite")
    parser.add_argument("--profile", choices=["v1", "contract", "exposure", "lifecycle"], default="v1")
    parser.add_argument("--thresholds")
    parser.add_argument("--fail-on-regression", action="store_true")
    parser.add_argument("--format", choices=["markdown", "json"], default="markdown")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = spark or SparkSession.builder.appName("spanveil-eval").getOrCreate()
    guard = Guard.full(key=KEY)
    try:
        if args.profile == "v1":
            report = reports.cases_report(suites.load_cases(spark, args.suite), guard)
        else:
            limits = gates.Thresholds.of(Path(args.thresholds).read_text()) if args.thresholds else None
            report = reports.REPORTS[args.profile](suites.load_suite(spark, args.suite), guard, limits)
    except GuardError as e:
        print(e, file=sys.stderr)
        return 2
    out.write(reports.as_json(report) if args.format == "json" else reports.markdown(report))
    return int(args.thresholds is not None and report["status"] == gates.FAIL or args.fail_on_regression and reports.regressed(report))


if __name__ == "__main__":
    sys.exit(main())
