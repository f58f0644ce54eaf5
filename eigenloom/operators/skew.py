"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class HotKeys:
    """(key, _salts) for the keys that need splitting, or nothing if no key does."""

    table: DataFrame | None


def hot_keys(big: DataFrame, key: str) -> HotKeys:
    """Keys holding more than one shuffle partition's share of ``big``, with the salts each needs.

    With ``parts`` partitions that is a 1/parts share. The counts of all keys add up to the row count,
    so fewer than ``parts`` keys can exceed it: the list is small whatever the data. It is found by one
    job over the key column, and a second one only if there is such a key.
    """
    spark = big.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.agg(F.sum("_n").alias("total"), F.max("_n").alias("top")).first()
    share = (found["total"] or 0) / parts
    if not share or found["top"] <= share:
        return HotKeys(None)
    hot = counts.where(F.col("_n") > share)
    hot = hot.select(key, F.ceil(F.col("_n") / share).cast("int").alias("_salts"))
    return HotKeys(spark.createDataFrame(hot.collect(), hot.schema))


def salted_join(
    big: DataFrame, small: DataFrame, key: str, spread: str, hot: HotKeys | None = None
) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row per key), hot keys of ``big`` split by ``spread``.

    Only rows of ``small`` whose key is hot are copied, once per salt. ``hot`` saves the count when
    the same big side is joined again. Without hot keys this is a plain join.
    """
    keys = (hot or hot_keys(big, key)).table
    if keys is None:
        return big.join(small, key)
    keys = F.broadcast(keys)
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_salts")))
    left = big.join(keys, key, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    right = small.join(keys, key, "left").withColumn("_salt", F.explode(salts)).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")
