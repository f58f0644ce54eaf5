"""Where size, shape or declared dimensions once changed an answer or dropped data."""

import eigenloom as el
import numpy as np
import pytest
from matrix_tools import array_of, entries_of
from eigenloom.plans.spaces import scan_tasks
from pyspark.sql import functions as F

FAR = 1_100_000
ENTRIES = "row_id long, col_id int, value double"


def nine_rows(spark):
    """Nine rows, three of which hold stored zeros only."""
    a = np.array([[1, 2], [3, 1], [0, 2], [2, 2], [1, 0], [4, 1]], float)
    cells = [(i, j, float(a[i, j])) for i in range(6) for j in range(2)] + [(i, 0, 0.0) for i in (6, 7, 8)]
    whole = np.vstack([a, np.zeros((3, 2))])
    sigma = np.linalg.svd(whole - whole.mean(axis=0), compute_uv=False)
    return spark.createDataFrame(cells, ENTRIES), sigma


@pytest.mark.parametrize("options", [{}, {"n_cols": 2}, {"n_cols": 2, "limit": 0}, {"limit": 0}])
@pytest.mark.parametrize("stored", [False, True])
def test_one_row_count(spark, options, stored):
    matrix, sigma = nine_rows(spark)
    fit = el.sketch_pca(el.to_rows(matrix) if stored else matrix, 1, oversample=1, max_iter=2, **options)
    assert fit.n_rows == 9 and np.allclose(fit.sigma, sigma[:1])


def test_rows_past_the_last_column_count(spark):
    matrix, _ = nine_rows(spark)
    more = matrix.unionByName(spark.createDataFrame([(20, 5, 1.0), (21, FAR, 1.0)], ENTRIES))
    for table in (more, el.to_rows(more)):
        for limit in (1 << 20, 0):
            assert el.sketch_pca(table, 1, max_iter=1, n_cols=2, limit=limit).n_rows == 11


def far_matrix(spark):
    cells = [(0, 5, 3.0), (0, 2_000_000, 1.0), (1, FAR, 2.0)]
    return spark.createDataFrame(cells, ENTRIES)


def test_centering_far_columns(spark):
    mu = np.zeros(FAR + 1)
    mu[[0, 5, FAR]] = 0.5, 1.0, 1.0
    cells = el.center_rows(el.to_rows(far_matrix(spark)), mu)
    found = cells.groupBy("row_id").agg(F.count("*").alias("n")).collect()
    assert {r.row_id: r.n for r in found} == {0: FAR + 1, 1: FAR + 1}
    some = {(r.row_id, r.col_id): r.value for r in cells.where("value <> 0").collect()}
    assert some == {(0, 0): -0.5, (1, 0): -0.5, (0, 5): 2.0, (1, 5): -1.0, (0, FAR): -1.0, (1, FAR): 1.0}


def test_one_line_per_row(spark, tmp_path):
    el.write_lil_text(far_matrix(spark), str(tmp_path / "lil"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "lil")).collect())
    assert lines == ["{1100000:2.0}", "{5:3.0,2000000:1.0}"]
    with pytest.raises(Exception, match="there is a row 1"):
        el.write_lil_text(far_matrix(spark), str(tmp_path / "a"), n_rows=1)
    near = spark.createDataFrame([(0, 4, 1.0)], ENTRIES)
    with pytest.raises(Exception, match="there is a column 4"):
        el.write_dense_text(near, str(tmp_path / "b"), n_cols=3)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_wide_spread_of_values(spark, limit):
    """Tree QR finds directions far below the square root of the precision, in either form."""
    rng = np.random.default_rng(3)
    u = np.linalg.qr(np.hstack([np.ones((60, 1)), rng.standard_normal((60, 3))]))[0][:, 1:]
    v = np.linalg.qr(rng.standard_normal((4, 3)))[0]
    sigma = np.array([13.76, 0.1338, 1.449e-6])
    matrix = entries_of(spark, (u * sigma) @ v.T)
    fit = el.sketch_pca_tsqr(matrix, 3, oversample=1, max_iter=2, n_rows=60, n_cols=4, limit=limit)
    assert len(fit.sigma) == 3 and np.allclose(fit.sigma, sigma, rtol=1e-5)
    found = array_of(fit.components, (4, 3), "col_id", "comp")
    assert np.allclose(np.abs((found * v).sum(axis=0)), 1, atol=1e-6)


def test_exact_with_declared_dimensions(spark):
    a = np.random.default_rng(1).standard_normal((30, 4))
    for matrix in (entries_of(spark, a), el.to_rows(entries_of(spark, a))):
        fit = el.exact_pca(matrix, 2, n_cols=3)
        right = np.linalg.svd(a[:, :3] - a[:, :3].mean(axis=0), compute_uv=False)
        assert np.allclose(fit.sigma, right[:2])
        with pytest.raises(ValueError):
            el.exact_pca(matrix, 2, n_rows=10)


def test_columns_that_cancel(spark):
    cells = [(0, 0, 1.0), (1, 0, -1.0), (1, 1, 2.0), (2, 3, 4.0)]
    matrix = spark.createDataFrame(cells, ENTRIES)
    for parts in (1, 4, 16):
        for table in (matrix.repartition(parts), el.to_rows(matrix).repartition(parts)):
            found = sorted(map(tuple, el.column_sums(table, 2).collect()))
            assert found == [(0, 0.0), (1, 2.0)]
        assert sorted(map(tuple, el.column_sums(el.to_rows(matrix)).collect())) == [(0, 0.0), (1, 2.0), (3, 4.0)]


@pytest.mark.parametrize("line", ["1,2,", "2,,3.0", ",1,4.0", "1,2", "1,2,3,4"])
def test_lines_that_lack_a_field(spark, tmp_path, line):
    (tmp_path / "c.csv").write_text(f"0,0,1.5\n{line}\n3,1,2.5\n")
    path = str(tmp_path / "c.csv")
    with pytest.raises(Exception, match="not row,col,value"):
        el.read_coo_text(spark, path).collect()
    assert el.read_coo_text(spark, path, malformed="drop").count() == 2
    assert el.rejected_lines(spark, path, "coo").first()["n"] == 1


def test_part_files_in_order_of_number(spark, tmp_path):
    for k in (99_999, 100_000, 10_001):
        (tmp_path / f"part-{k:05}-x.txt").write_text(f"{k}\n")
    rows = el.read_dense_text(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r["values"] for r in rows] == [[10_001.0], [99_999.0], [100_000.0]]


def test_scan_tasks():
    """Exchanged: tasks times factor. Below a quarter of the input, and no task above 1 GB."""
    for size in (1, 1 << 30, 100 << 40):
        for factor in (1 << 10, 16 << 20, 64 << 20, 1 << 30):
            tasks = scan_tasks(size, factor)
            assert size / tasks <= 1 << 30
            assert tasks == 1 or factor > 256 << 20 or (tasks - 1) * factor <= size / 4
