"""Reading and writing of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> str:
    """Write a result as parquet, sorted by nothing; returns the path."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def filtered_name(version: str, sample: str | None) -> str:
    """The name of a filtered sample's table."""
    return f"{version}{sample}_filtered.parquet"
