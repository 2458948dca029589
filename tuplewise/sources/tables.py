"""Readers of entity tables for a catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def parquet(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    """Tables are ``{folder}/{table}.parquet``."""
    return lambda table: spark.read.parquet(f"{folder}/{table}.parquet")


def jdbc(spark: SparkSession, url: str, properties: dict[str, str] | None = None, split: dict[str, tuple[str, int, int, int]] | None = None) -> Callable[[str], DataFrame]:
    """Tables of a database, whose driver must be on Spark's class path; filters and columns are pushed down.

    ``split``: for a table the number column, its bounds and the number of partitions to read by.
    """

    def read(table: str) -> DataFrame:
        if split and table in split:
            column, low, high, parts = split[table]
            return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)
        return spark.read.jdbc(url, table, properties=properties)

    return read
