"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Parquet scan. ``partitions`` deals the rows of a table that comes in few splits over so many tasks, for CPU-bound row
    expressions (JSON, URL, slug); a large table needs no such thing."""
    df = spark.read.parquet(path)
    return df.repartition(partitions) if partitions else df
