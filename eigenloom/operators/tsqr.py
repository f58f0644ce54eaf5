"""R of a tall, narrow QR factorisation, folded through tasks and then through a tree of groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .blocks import batch_vectors
from .products import vector_batch

# R's that one task of a merge holds.
FAN_IN = 32

PARTS = "bucket int, i int, vec array<double>"


def fold_r(r: np.ndarray, block: np.ndarray) -> np.ndarray:
    """R of [r; block], with a non-negative diagonal."""
    r = np.linalg.qr(np.vstack([r, block]), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] if len(r) else r


def r_batch(r: np.ndarray, bucket: int):
    order = np.arange(len(r), dtype=np.int32)
    return vector_batch(["bucket", "i"], [np.full_like(order, bucket), order], r)


def task_r(blocks, width: int, fan_in: int):
    """Fold an iterator of (n, width) arrays into one R and emit it for its group of ``fan_in`` tasks."""
    r = np.zeros((0, width))
    for block in blocks:
        r = fold_r(r, block)
    if len(r):
        yield r_batch(r, TaskContext.get().partitionId() // fan_in)


def merge_r(parts: DataFrame, width: int) -> DataFrame:
    """One R per bucket from the R's of its tasks."""

    def job(key, group):
        r = np.zeros((0, width))
        for batch in group.to_batches():
            r = fold_r(r, batch_vectors(batch, width))
        return pa.Table.from_batches([r_batch(r, key[0].as_py())])

    return parts.groupBy("bucket").applyInArrow(job, PARTS)


def tree_r(parts: DataFrame, width: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge the R's of groups level by level down to a single R (bucket 0).

    A group holds at most ``fan_in`` x ``width`` rows whatever the number of tasks; the number of levels
    is its logarithm, from the bound that the plan of the scores gives.
    """
    if fan_in < 2:
        raise ValueError("a merge needs a fan-in of at least 2")
    groups = -(-parts.rdd.getNumPartitions() // fan_in)
    merged = merge_r(parts, width)
    while groups > 1:
        merged = merge_r(merged.withColumn("bucket", F.expr(f"bucket div {fan_in}").cast("int")), width)
        groups = -(-groups // fan_in)
    return merged


def tsqr_r(scores: DataFrame, zm: np.ndarray, fan_in: int = FAN_IN) -> DataFrame:
    """(i, vec) rows of R with R'R = (Z - 1 zm)'(Z - 1 zm)."""
    width = len(zm)

    def job(batches):
        yield from task_r((batch_vectors(b, width) - zm for b in batches), width, fan_in)

    parts = scores.select("vec").mapInArrow(job, PARTS)
    return tree_r(parts, width, fan_in)
