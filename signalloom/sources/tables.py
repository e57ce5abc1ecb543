"""Scans of the driver tables with the column types that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``t``, microseconds since the epoch."""
    return table(spark, folder, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
