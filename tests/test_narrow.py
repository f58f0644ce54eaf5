"""Full rows of a few columns: passes over them are column expressions, and no row goes to Python."""

import eigenloom as el
import numpy as np
import pytest
from eigenloom.operators import narrow
from eigenloom.workload.fixtures import lineitem5
from eigenloom.workload.queries import QUERIES
from matrix_tools import array_of
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame
from test_scan_space import lineitem, numbers_of


@pytest.fixture
def to_python(monkeypatch):
    """The columns of tables whose rows go to Python, but for factors and means."""
    seen, plain = [], DataFrame.mapInArrow

    def noted(self, *args, **options):
        if "values" in self.columns:
            seen.append(self.columns)
        return plain(self, *args, **options)

    monkeypatch.setattr(DataFrame, "mapInArrow", noted)
    return seen


def no_row_in_python(spark, folder, name, to_python):
    lineitem(spark, folder)
    assert numbers_of(QUERIES[name](spark, str(folder))).size
    assert not to_python


def test_kth_singular_value(spark, tmp_path, to_python):
    no_row_in_python(spark, tmp_path, "kth_singular_value_tables", to_python)


def test_sketch_pca_sparse_sign(spark, tmp_path, to_python):
    no_row_in_python(spark, tmp_path, "sketch_pca_sparse_sign_tables", to_python)


def test_sketch_pca_two_pass(spark, tmp_path, to_python):
    no_row_in_python(spark, tmp_path, "sketch_pca_two_pass_tables", to_python)


def test_residual_norm(spark, tmp_path, to_python):
    no_row_in_python(spark, tmp_path, "residual_norm_tables", to_python)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_sums_are_those_of_python(spark, tmp_path, monkeypatch, limit):
    """Nulls count as zeros in tables, and are an error in arrays, either way."""
    lineitem(spark, tmp_path, nulls=limit == 0)
    options = dict(oversample=2, max_iter=1, limit=limit, n_rows=305)
    fits = []
    for columns in (8, 0):
        monkeypatch.setattr(narrow, "NARROW_COLUMNS", columns)
        fits.append(el.sketch_pca(lineitem5(spark, str(tmp_path)), 2, n_cols=5, **options))
    assert np.allclose(fits[0].sigma, fits[1].sigma, rtol=1e-10)
    found = [array_of(f.components, (5, 2), "col_id", "comp") for f in fits]
    assert np.allclose(*found, atol=1e-8)


def test_nulls_of_a_local_fit_are_an_error(spark, tmp_path):
    lineitem(spark, tmp_path, nulls=True)
    with pytest.raises(ValueError, match="NaN"):
        el.sketch_pca(lineitem5(spark, str(tmp_path)), 2, max_iter=1)


def test_rows_that_lack_a_cell_go_the_other_way(spark, to_python):
    a = np.random.default_rng(5).normal(size=(30, 4))
    rows = spark.createDataFrame([(i, 0, [0, 1, 2, 3], a[i].tolist()) for i in range(30)], "row_id long, segment int, indices array<int>, values array<double>")
    short = rows.withColumns({c: F.when(F.col("row_id") == 7, F.slice(c, 1, 2)).otherwise(F.col(c)) for c in ("indices", "values")})
    assert narrow.is_full(rows, 4) and not narrow.is_full(rows, 3) and not narrow.is_full(short, 4)
    a[7, 2:] = 0
    right = np.linalg.svd(a - a.mean(axis=0), compute_uv=False)
    for limit in (0, 1 << 20):
        assert np.allclose(el.sketch_pca(short, 3, max_iter=3, n_cols=4, limit=limit).sigma, right[:3])
    assert to_python


def test_empty_rows_and_totals_of_blocks(spark):
    cells = spark.range(200_000).selectExpr("0.1D AS y0", "CAST(id AS DOUBLE) AS y1")
    assert np.allclose([r["value"] for r in narrow.narrow_column_sums(cells).sort("col_id").collect()], [20_000, 19_999_900_000], rtol=1e-13)
    found = narrow.narrow_scan(cells.limit(0), np.eye(2), np.zeros(2), (1, 0)).collect()
    assert len(found) == 5 and not any(x for r in found for x in r["vec"])
    assert narrow.narrow_scan(cells, np.full((2, 2), np.nan), np.zeros(2), (1, 0)) is None
