"""Parquet scans of the driver tables.

Plain ``spark.read.parquet``: Catalyst prunes columns and pushes filters
into the scan, so callers should select / filter as early as they can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def register_tables(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Register the driver tables as temp views (for SQL users)."""
    for n in names or TABLES:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
