"""Parquet tables of a dataset folder (one ``<name>.parquet`` per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one table; projections and filters downstream reach the Parquet reader."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
