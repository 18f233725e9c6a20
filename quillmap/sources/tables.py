"""The Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``name`` as Spark reads it: a file or a folder of part files, on any file system that Spark knows."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
