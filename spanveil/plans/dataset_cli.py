"""python -m spanveil.plans.dataset_cli --action fetch|normalize --manifest FILE --cache FOLDER [--mapping FILE]. Exit 0: done; 1: failed; 2: bad use."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from ..operators.errors import GuardError
from ..sources import datasets
from . import gates
from .mapping import Mapping


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanveil-data")
    parser.add_argument("--action", required=True, choices=["fetch", "normalize"], type=lambda x: x.strip().lower())
    parser.add_argument("--manifest", required=True)
    parser.add_argument("--mapping")
    parser.add_argument("--cache", required=True)
    try:
        args = parser.parse_args(argv)
        if args.action == "normalize" and not (args.mapping or "").strip():
            parser.error("normalize needs --mapping")
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        manifest = gates.manifest(Path(args.manifest).read_text(encoding="utf-8"))
        if args.action == "fetch":
            datasets.fetch(manifest, args.cache)
        else:
            mapping = Mapping.of(gates.read_json(Path(args.mapping).read_text(encoding="utf-8")))
            datasets.normalize(spark or SparkSession.builder.appName("spanveil-data").getOrCreate(), manifest, mapping, args.cache)
    except (GuardError, OSError) as e:
        print(f"{args.action}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
