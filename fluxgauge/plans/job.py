"""Batch job: features of one day.

    spark-submit --py-files fluxgauge.zip fluxgauge/plans/job.py \
        --input <hourly table> --output <feature table> --date 2024-01-15
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from fluxgauge.plans.features import features_of_day
from fluxgauge.session import build_session
from fluxgauge.sources.readers import read_hourly
from fluxgauge.sources.writers import write_features


def run(spark: SparkSession, input_path: str, output_path: str, date: str) -> dict[str, int]:
    """Read the day and its look-back, compute, replace the day's partitions."""
    hourly = read_hourly(spark, input_path, date)
    return write_features(features_of_day(hourly, date), output_path)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("input", "output", "date"):
        parser.add_argument(f"--{name}", required=True)
    args = parser.parse_args(argv)
    report = run(build_session("fluxgauge-features"), args.input, args.output, args.date)
    print(f"{report['rows']} rows, {report['columns']} columns")


if __name__ == "__main__":
    main()
