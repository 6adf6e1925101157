"""Relational tables: parquet folders, JDBC, temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, *, key: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A database table; with a numeric key and its bounds it is read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        low, high = bounds
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions)
    return reader.load()


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
