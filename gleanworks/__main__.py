"""Command line: ``python -m gleanworks census-export CORPUS_DIR OUT.csv [--table T] [--min-rate R]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import census, corpus
from .sources import exports


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gleanworks")
    commands = parser.add_subparsers(dest="command", required=True)
    export = commands.add_parser("census-export", help="write the census of a frozen corpus as CSV")
    export.add_argument("corpus")
    export.add_argument("out")
    export.add_argument("--table")
    export.add_argument("--min-rate", type=float, default=0.0)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("census-export").getOrCreate()
    rows = census.census_page(corpus.read_corpus(spark, args.corpus, "census"), args.table, args.min_rate)
    exports.export("census", rows, f"{args.out}.parts", context=args.corpus)
    exports.gather(spark, f"{args.out}.parts", args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
