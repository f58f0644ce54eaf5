"""Column expressions on packed vectors (``vec ARRAY<DOUBLE>`` of a known width).

The expressions are given as SQL text: with one term per component, building them call by call from
Python takes longer than the small jobs they run in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _array_of(width: int) -> Column:
    return F.expr("array(" + ", ".join(f"c{j}" for j in range(width)) + ")").alias("vec")


def pack(long: DataFrame, key: str, width: int) -> DataFrame:
    """(key, comp, value) rows to one (key, vec) row per key; absent entries become 0."""
    cells = [F.expr(f"sum(if(comp = {j}, value, 0.0D)) AS c{j}") for j in range(width)]
    return long.groupBy(key).agg(*cells).select(key, _array_of(width))


def unpack(packed: DataFrame, key: str, comp: str = "comp", value: str = "value") -> DataFrame:
    """(key, vec) rows to (key, comp, value) rows."""
    return packed.select(key, F.posexplode("vec").alias(comp, value))


def sum_vectors(df: DataFrame, keys: list[str], width: int, weight: str | None = None) -> DataFrame:
    """Element-wise sum of ``vec`` per key, optionally weighted, with map-side partial sums."""
    times = "" if weight is None else f"{weight} * "
    cells = [F.expr(f"sum({times}vec[{j}]) AS c{j}") for j in range(width)]
    return df.groupBy(*keys).agg(*cells).select(*keys, _array_of(width))


def dot(left: str, right: str, width: int) -> Column:
    """Inner product of two packed vectors as a sum of products."""
    return F.expr(" + ".join(f"{left}[{j}] * {right}[{j}]" for j in range(width)))


def numbers(values) -> Column:
    """Plain numbers as an array literal."""
    return F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in values) + ")")
