"""`python -m tradewind <raw folder> <lake folder>`: one refresh, with its counts printed."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tradewind.plans.refresh import refresh


def main() -> None:
    parser = argparse.ArgumentParser(prog="tradewind", description=__doc__)
    parser.add_argument("raw_dir")
    parser.add_argument("root")
    which = parser.add_mutually_exclusive_group()
    which.add_argument("--limit", type=int, help="cluster only so many of the oldest waiting reviews")
    which.add_argument("--no-themes", action="store_true")
    options = parser.parse_args()

    spark = SparkSession.builder.appName("tradewind").getOrCreate()
    report = refresh(spark, options.raw_dir, options.root, with_themes=not options.no_themes, limit=options.limit)
    for table, rows in sorted(report.row_counts.items()):
        print(f"{table}: {rows} rows written")
    for check, failures in report.checks.items():
        print(f"{check}: {failures} failures")
    if report.themes is not None:
        print(f"themes: k={report.themes.k}")
    spark.stop()


if __name__ == "__main__":
    main()
