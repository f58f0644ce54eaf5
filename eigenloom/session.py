"""Shared-storage scratch space and the size limits used across the package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A column-by-sketch factor up to this size may be broadcast; a larger one stays a table.
FACTOR_LIMIT_BYTES = 64 << 20

# Widest stretch of columns held in one row array. Wider rows are cut into segments.
SEGMENT_WIDTH = 1 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only in local mode."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(root)
        return root
    root = context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="eigenloom-")
    context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/eigenloom-{uuid.uuid4().hex}/{name}"


def as_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` under a scratch path and scan it back: cuts lineage, survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, with the folder made for it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def full_path(spark: SparkSession, path: str) -> str:
    """A path with its file system, for tasks that read it themselves."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def fits_broadcast(n_cols: int, width: int, limit: int = FACTOR_LIMIT_BYTES) -> bool:
    return n_cols <= SEGMENT_WIDTH and n_cols * width * 8 <= limit
