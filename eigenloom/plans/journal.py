"""A journal of a fit: what a pass leaves is written before the next begins, so that a fit can go on later."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

STATE = "pass int, settings string, sigma array<double>, errors array<double>, n_rows long, folder string"


class Journal:
    """Passes under ``path``: a folder of tables for each, then one row in ``state`` that commits it.

    A pass whose row is missing did not finish and is done again; its folder is not read. Folders are never
    written twice, so two attempts cannot mix.
    """

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark, self.path = spark, path.rstrip("/")
        self.settings = json.dumps(settings, sort_keys=True)
        spark.createDataFrame([], STATE).write.mode("append").parquet(f"{self.path}/state")

    def states(self) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(f"{self.path}/state")

    def last(self):
        """The state of the last finished pass, or None. Passes of other settings are an error."""
        other = self.states().where(F.col("settings") != self.settings).limit(1).collect()
        if other:
            raise ValueError(f"{self.path} is the journal of another fit: {other[0]['settings']}")
        found = self.states().orderBy(F.desc("pass")).limit(1).collect()
        return found[0] if found else None

    def factor(self, state) -> DataFrame:
        return self.spark.read.parquet(f"{state['folder']}/factor")

    def means(self, state) -> DataFrame:
        return self.spark.read.parquet(f"{state['folder']}/means")

    def commit(self, number: int, factor: DataFrame, means: DataFrame, sigma: np.ndarray, errors: list, n_rows: int) -> None:
        """Write the tables of a pass, then the row that makes them count."""
        folder = f"{self.path}/pass-{number:04}-{uuid.uuid4().hex}"
        factor.write.parquet(f"{folder}/factor")
        means.write.parquet(f"{folder}/means")
        row = (number, self.settings, [float(x) for x in sigma], [float(x) for x in errors], n_rows, folder)
        self.spark.createDataFrame([row], STATE).write.mode("append").parquet(f"{self.path}/state")
