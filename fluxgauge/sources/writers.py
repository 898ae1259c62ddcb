"""Batch sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_features(
    df: DataFrame, path: str, partitions: tuple[str, ...] = ("site", "date"), report: bool = True
) -> dict[str, int]:
    """Write features by site and date, replacing only the partitions present in ``df``.

    Returns the row and column count, taken while writing. Rows of one partition come from
    at most a few tasks: ``rebalance`` clusters them and splits a site-day that is too large.
    """
    observed = Observation()
    out = observe_rows(df, observed) if report else df
    (
        out.hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy(*partitions)
        .parquet(path)
    )
    return {"rows": observed.get["rows"], "columns": len(df.columns)} if report else {}


def observe_rows(df: DataFrame, observation: Observation) -> DataFrame:
    """Count rows as a side effect of the next action on the result."""
    return df.observe(observation, F.count(F.lit(1)).alias("rows"))


def run_report(df: DataFrame) -> DataFrame:
    """Row and column count as a table, for a plan that is not written."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
