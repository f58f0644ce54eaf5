"""Every registered query against its SQL at sf0.001, and the shape of the registry."""

import check
import pytest
from eigenloom.workload.oracle import ORACLE
from eigenloom.workload.queries import QUERIES

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check.database(SF)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLE) == {"sketch_pca_sparse"}


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    assert check.compare(spark, db, name, SF) == []
