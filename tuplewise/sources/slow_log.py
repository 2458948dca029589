"""The slow-query log: text records that are appended by the driver and read as a table."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(path: str | Path, text: str, took: float, rows: int, statements: int = 1) -> None:
    """Append a record: time, seconds, rows and number of statements, then the query on lines of its own."""
    now = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = "\n".join(line.strip() for line in text.strip().splitlines() if line.strip())
    with Path(path).open("a", encoding="utf-8") as out:
        out.write(f"# Time: {now}\n# Query_time: {took:.6f} Rows_sent: {rows} Statements: {statements}\n{body}\n\n")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: time, seconds, rows_sent, statements, query."""
    raw = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    head = r"(?s)^\s*# Time: (\S+)\n# Query_time: ([0-9.]+) Rows_sent: (\d+) Statements: (\d+)\n(.*)$"
    part = lambda i: F.regexp_extract("value", head, i)
    return raw.where(F.col("value").rlike(head)).select(part(1).alias("time"), part(2).cast("double").alias("seconds"), part(3).cast("long").alias("rows_sent"), part(4).cast("int").alias("statements"), F.trim(part(5)).alias("query"))
