"""Readers for the Parquet tables a deployment points us at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.session import configure


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Read ``<base_dir>/<name>.parquet``; projections and filters prune the scan."""
    configure(spark)
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")
