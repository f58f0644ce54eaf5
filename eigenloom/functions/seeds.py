"""Start matrices of a sketch, as functions of (seed, col_id, comp) only.

Every entry comes from an integer mix of its own coordinates, so the matrix is the same for any
partitioning, is rebuilt alike after an executor is lost, and is plain codegen: no Python, no state.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A public 32-bit integer mixer, an odd 31-bit stride for the component number, an offset
# (the golden ratio in 32 bits) that keeps seed 0 and id 0 away from the mixer's fixed point 0, and an odd
# stride for the high word of an id.
MIX_MULTIPLIER = 73244475
COMP_STRIDE = 1540483477
SEED_OFFSET = 2654435769
HIGH_STRIDE = 2246822519
WORD = 1 << 32

# Draws of a column of a sparse sign matrix.
SIGNS = 8


def mixed(x: int) -> int:
    """Scramble a number below 2**32 into another one."""
    for _ in range(2):
        x = (x ^ (x >> 16)) * MIX_MULTIPLIER % WORD
    return x ^ (x >> 16)


def seed_state(seed: int) -> int:
    return mixed((seed + SEED_OFFSET) % WORD)


def mix32(x: str) -> str:
    """SQL text of ``mixed`` for an integer expression."""
    for _ in range(2):
        x = f"(({x} ^ shiftright({x}, 16)) * {MIX_MULTIPLIER}L % {WORD}L)"
    return f"({x} ^ shiftright({x}, 16))"


def id_state(seed: int, name: str) -> str:
    """SQL text of the mixed state of one id column, all 64 bits of it, under a seed."""
    wide = f"CAST({name} AS BIGINT)"
    low = mix32(f"(({wide} & {WORD - 1}L) ^ {seed_state(seed)}L)")
    # The high word has a round of its own: folded onto the low one, ids of two partitions would share states.
    return f"CASE WHEN {wide} BETWEEN 0 AND {WORD - 1}L THEN {low} ELSE " + mix32(
        f"({low} ^ (shiftrightunsigned({wide}, 32) * {HIGH_STRIDE}L % {WORD}L))"
    ) + " END"


def unit(state: str) -> str:
    """SQL text of a state as a number in (0, 1)."""
    return f"(({state} + 0.5D) / {float(WORD)!r}D)"


def uniform(seed: int, name: str) -> Column:
    """A number in (0, 1) that depends only on the seed and an id column."""
    return F.expr(unit(id_state(seed, name)))


def _stream(comp: str) -> str:
    """The uniform number of a component, from the column's state in ``_state``."""
    return unit(mix32(f"(_state ^ (CAST({comp} AS BIGINT) * {COMP_STRIDE}L % {WORD}L))"))


def _gaussian(comp: str) -> str:
    """Box-Muller on two uniform streams per component."""
    radius, angle = _stream(f"({comp} * 2)"), _stream(f"({comp} * 2 + 1)")
    return f"sqrt(-2.0D * ln({radius})) * cos({2.0 * math.pi!r}D * {angle})"


def column_range(spark: SparkSession, n_cols: int) -> DataFrame:
    return spark.range(n_cols).select(F.col("id").cast("int").alias("col_id"))


def _cells(cols: DataFrame, width: int) -> DataFrame:
    comp = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("comp")
    return cols.select(*cols.columns, comp)


def _with_state(cols: DataFrame, seed: int) -> DataFrame:
    return cols.select("col_id", F.expr(id_state(seed, "col_id")).alias("_state"))


def uniform_seed(cols: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """Entries uniform on (0, 1) for each column in ``cols``."""
    cells = _cells(_with_state(cols, seed), width)
    return cells.select("col_id", "comp", F.expr(_stream("comp")).alias("value"))


def gaussian_seed(cols: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """Standard normal entries for each column in ``cols``."""
    cells = _cells(_with_state(cols, seed), width)
    return cells.select("col_id", "comp", F.expr(_gaussian("comp")).alias("value"))


def gaussian_vectors(cols: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """The same entries packed by column, without an exchange; the expression does not grow with the width."""
    vec = F.expr(f"transform(sequence(0, {width - 1}), comp -> {_gaussian('comp')})")
    return _with_state(cols, seed).select("col_id", vec.alias("vec"))


def sparse_sign_seed(cols: DataFrame, width: int, seed: int = 0, nonzeros: int = SIGNS) -> DataFrame:
    """For each column, ``nonzeros`` draws of a component and a sign, summed over the square root of their number.

    Draws may meet in a component. With one draw this is a count sketch. Only entries drawn are listed.
    """
    draws = F.explode(F.sequence(F.lit(0), F.lit(checked_draws(nonzeros) - 1))).alias("draw")
    cells = _with_state(cols, seed).select("col_id", "_state", draws)
    word = mix32(f"(_state ^ (CAST(draw AS BIGINT) * {COMP_STRIDE}L % {WORD}L))")
    cells = cells.select("col_id", F.expr(word).alias("_word"))
    cells = cells.select(
        "col_id",
        F.expr(f"CAST(shiftright(_word, 1) % {width} AS INT)").alias("comp"),
        F.expr("_word % 2 * 2.0D - 1.0D").alias("sign"),
    )
    return cells.groupBy("col_id", "comp").agg((F.sum("sign") / F.lit(math.sqrt(nonzeros))).alias("value"))


def checked_draws(nonzeros: int) -> int:
    if nonzeros < 1:
        raise ValueError("nonzeros must be at least 1")
    return nonzeros


def mixed_words(x: np.ndarray) -> np.ndarray:
    """``mixed`` for an array of numbers below 2**32."""
    word = np.uint64(WORD - 1)
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(MIX_MULTIPLIER)) & word
    return x ^ (x >> np.uint64(16))


def sign_vectors(col_ids: np.ndarray, width: int, seed: int, nonzeros: int) -> np.ndarray:
    """The rows of ``sparse_sign_seed`` for some column ids, computed from the ids inside a task."""
    state = mixed_words(col_ids.astype(np.uint64) ^ np.uint64(seed_state(seed)))
    out = np.zeros((len(col_ids), width))
    for draw in range(checked_draws(nonzeros)):
        word = mixed_words(state ^ np.uint64(draw * COMP_STRIDE % WORD))
        comp = ((word >> np.uint64(1)) % np.uint64(width)).astype(np.int64)
        out[np.arange(len(out)), comp] += (word & np.uint64(1)).astype(np.float64) * 2 - 1
    return out / math.sqrt(nonzeros)


def validation_seed(cols: DataFrame, width: int) -> DataFrame:
    """The deterministic check matrix ``(col_id + comp) mod 10 + 1``."""
    value = (F.col("col_id") + F.col("comp")) % 10 + 1
    return _cells(cols.select("col_id"), width).withColumn("value", value.cast("double"))
