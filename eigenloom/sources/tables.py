"""Stored matrices: Parquet tables of sparse rows or of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_matrix(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A stored matrix. ``partitions`` asks for at least that many scan tasks, at the cost of an exchange."""
    matrix = spark.read.parquet(path)
    return matrix.repartition(partitions) if partitions else matrix
