"""Factors beyond the broadcast limit that scan tasks read themselves: nothing as long as the matrix is stored."""

import eigenloom as el
import numpy as np
import pytest
from eigenloom.plans import spaces
from eigenloom.workload.queries import QUERIES
from matrix_tools import array_of, entries_of
from pyspark.sql import functions as F


@pytest.fixture
def stored_rows(monkeypatch):
    """Row counts of all tables that a table space writes between steps."""
    counts, stored = [], spaces.TableSpace.stored

    def counted(self, df, name, paths):
        table, path = stored(self, df, name, paths)
        counts.append(table.count())
        return table, path

    monkeypatch.setattr(spaces.TableSpace, "stored", counted)
    return counts


def lineitem(spark, folder, nulls=False):
    rng = np.random.default_rng(2)
    rows = [
        (float(q), float(p), float(d) / 100, float(t) / 100, int(n))
        for q, p, d, t, n in zip(*(rng.integers(1, top, 300) for top in (50, 90_000, 10, 8, 7)))
    ]
    if nulls:
        rows[3:9] = [(None, *r[1:4], None) for r in rows[3:9]]
    schema = "l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linenumber int"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/lineitem.parquet")


def numbers_of(df):
    return np.array([[float(x) for x in r] for r in df.sort(*df.columns).collect()])


def same_as_local(spark, folder, name, stored_rows):
    lineitem(spark, folder)
    found = numbers_of(QUERIES[f"{name}_tables"](spark, str(folder)))
    # Means, factors of five columns and sums of a pass: no scores, no cells.
    assert stored_rows and max(stored_rows) <= 11
    assert np.allclose(found, numbers_of(QUERIES[name](spark, str(folder))), atol=2e-3)


def test_wide_sparse_rows_meet_the_factor_where_they_lie(spark, monkeypatch):
    """Rows of several segments and repeated cells, of more columns than a segment has."""
    rng = np.random.default_rng(4)
    columns = np.array([0, 5, 7, 600_000, 1_048_575, 1_048_576, 1_099_999])
    a = rng.integers(0, 4, (40, 7)).astype(float)
    cells = [(i, int(c), float(a[i, j]) / 2) for i in range(40) for j, c in enumerate(columns) for _ in range(2)]
    # Tiles exchange a score for nearly every cell of such a matrix, twice a pass.
    monkeypatch.setattr(spaces.Tiles, "store", None)
    matrix = spark.createDataFrame(cells, "row_id long, col_id int, value double")
    right = np.linalg.svd(np.vstack([a, np.zeros((3, 7))]) - a.sum(axis=0) / 43, compute_uv=False)
    for table in (matrix, el.to_rows(matrix)):
        fit = el.sketch_pca(table, 2, oversample=5, max_iter=2, n_rows=43, n_cols=1_100_000)
        assert np.allclose(fit.sigma, right[:2])


def test_residual_norm(spark, tmp_path, stored_rows):
    same_as_local(spark, tmp_path, "residual_norm", stored_rows)


def test_sketch_pca_tsqr(spark, tmp_path, stored_rows):
    same_as_local(spark, tmp_path, "sketch_pca_tsqr", stored_rows)


def test_sketch_pca_two_pass(spark, tmp_path, stored_rows):
    same_as_local(spark, tmp_path, "sketch_pca_two_pass", stored_rows)


def test_sketch_pca_sparse_sign(spark, tmp_path, stored_rows):
    same_as_local(spark, tmp_path, "sketch_pca_sparse_sign", stored_rows)


def test_kth_singular_value(spark, tmp_path, stored_rows):
    same_as_local(spark, tmp_path, "kth_singular_value", stored_rows)


@pytest.mark.parametrize("method", ["fused", "two_pass", "tsqr"])
@pytest.mark.parametrize("start", ["gaussian", "sparse_sign"])
def test_scans_and_tiles_agree(spark, tmp_path, monkeypatch, method, start):
    lineitem(spark, tmp_path, nulls=True)
    from eigenloom.workload.fixtures import lineitem5

    options = dict(oversample=2, max_iter=2, method=method, start=start, limit=0)
    scan = el.sketch_pca(lineitem5(spark, str(tmp_path)), 2, **options)
    monkeypatch.setattr(spaces, "HELD_BYTES", 0)
    tiles = el.sketch_pca(lineitem5(spark, str(tmp_path)), 2, **options)
    assert np.allclose(scan.sigma, tiles.sigma, rtol=1e-9)
    found = [array_of(f.components, (5, 2), "col_id", "comp") for f in (scan, tiles)]
    assert np.allclose(*found, atol=1e-7)


@pytest.mark.parametrize("name", [f"{n}_tables" for n in ("residual_norm", "sketch_pca_tsqr", "sketch_pca_two_pass", "sketch_pca_sparse_sign", "kth_singular_value")])
def test_narrow_factors_leave_the_splits(spark, tmp_path, monkeypatch, name):
    """Four files of some planned megabytes and a factor of half a kilobyte: a pass was one task."""
    opened = spaces.ScanSpace.__init__

    class Opened(Exception):
        pass

    def opening(self, *args):
        opened(self, *args)
        raise Opened(self.rows.rdd.getNumPartitions())

    monkeypatch.setattr(spaces.ScanSpace, "__init__", opening)
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    cells = [((j + 1) * F.rand(j)).alias(c) for j, c in enumerate(columns)]
    table = spark.range(0, 200_000, 1, 4).select(*cells, (F.col("id") % 7).cast("int").alias("l_linenumber"))
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    with pytest.raises(Opened) as found:
        QUERIES[name](spark, str(tmp_path))
    assert 1 < found.value.args[0] <= 4


def test_declared_rows_are_checked(spark):
    a = np.eye(4)
    with pytest.raises(ValueError, match="holds 4 rows"):
        el.sketch_pca(entries_of(spark, a), 1, max_iter=1, n_rows=3, n_cols=4, limit=0)
