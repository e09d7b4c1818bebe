"""Rows dealt by ranges of a key, so that a running sum over a whole table needs no task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from safespan.session import materialize

PART = "_part"


def dealt(df: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """df in ranges of the key, with their numbers in order as PART. Written once, so that the ranges stay what they are for
    every later reading."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, key).withColumn(PART, F.spark_partition_id()), "ranges")
