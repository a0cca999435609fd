"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under sf_dir; columns are pruned and filters pushed down by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical_json(text: Column) -> Column:
    """One spelling for equal JSON values: keys sorted, white space and escapes undone.

    Text that is no JSON stays as it is, behind a mark that no JSON value has; null stays null.
    """
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.concat(F.lit("\u0000"), text))
