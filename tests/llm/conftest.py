import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_rows import ODD  # noqa: E402

CLASHING = "row class label name kept score lang_pred blocks bucket group_size _a _b _doc _text ids seq at spans doc tag"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text) pairs, with further columns named like those of the operators."""

    def make(rows, extra=True, parts=3):
        df = spark.createDataFrame(list(rows), "doc_id long, text string").repartition(parts)
        if extra:
            for k, c in enumerate(CLASHING.split()):
                df = df.selectExpr("*", f"{k} AS `{c}`")
        return df

    return make


@pytest.fixture(scope="session")
def odd(table):
    return table(ODD)


@pytest.fixture(scope="session")
def empty(table):
    return table([])
