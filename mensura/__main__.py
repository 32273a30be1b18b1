"""Command line: python -m mensura COMMAND."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

#: Exit codes and what they say.
EXIT_CODES = {0: "success", 1: "the command failed", 2: "wrong usage"}


def describe(code: int) -> str:
    return EXIT_CODES.get(code, "unknown")


def is_handler_code(code: int) -> bool:
    return code in EXIT_CODES


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mensura")
    sub = p.add_subparsers(dest="command")
    for name in ("version", "info", "modules", "constants", "list"):
        sub.add_parser(name)
    run = sub.add_parser("run", help="run a registered query")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("--rows", type=int, default=20)
    stats = sub.add_parser("stats", help="describe the columns of a CSV or Parquet file")
    stats.add_argument("path")
    hyp = sub.add_parser("hypothesis")
    hyp.add_argument("question")
    hyp.add_argument("-n", type=int, default=3)
    sample = sub.add_parser("sample", help="draw from a distribution")
    sample.add_argument("kind", choices=["gaussian", "exponential", "poisson", "uniform"])
    sample.add_argument("-n", type=int, default=10)
    sample.add_argument("--seed", type=int, default=0)
    return p


def main(argv: Sequence[str] | None = None) -> int:
    parser = build_parser()
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    import mensura

    if args.command is None:
        parser.print_help()
        return 2
    if args.command in ("version", "info"):
        print("mensura", mensura.__version__)
        return 0
    if args.command == "constants":
        from mensura.functions.science import CONSTANTS

        print("\n".join(f"{k} = {v:g}" for k, v in CONSTANTS.items()))
        return 0
    if args.command == "modules":
        print("operators sources functions plans streaming")
        return 0
    if args.command == "hypothesis":
        from mensura.plans.workflow import generate_hypotheses

        print("\n".join(h.statement for h in generate_hypotheses(args.question, n=args.n)))
        return 0
    from mensura.plans import registry

    if args.command == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("mensura").getOrCreate()
    try:
        if args.command == "run":
            if args.query not in registry.queries():
                print(f"unknown query: {args.query}", file=sys.stderr)
                return 2
            registry.queries()[args.query](spark, args.tables).show(args.rows, truncate=False)
        elif args.command == "stats":
            from mensura.operators.frame import describe as describe_table
            from mensura.sources.files import load_csv

            describe_table(load_csv(spark, args.path) if args.path.endswith(".csv") else spark.read.parquet(args.path)).show()
        else:
            from mensura.functions import distributions as d

            {"gaussian": lambda: d.gaussian_sample(spark, args.n, seed=args.seed), "exponential": lambda: d.exponential_sample(spark, args.n, seed=args.seed), "poisson": lambda: d.poisson_sample(spark, args.n, seed=args.seed), "uniform": lambda: d.uniform_sample(spark, 0.0, 1.0, args.n, args.seed)}[args.kind]().show(args.n)
        return 0
    except Exception as e:  # the exit code tells
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
