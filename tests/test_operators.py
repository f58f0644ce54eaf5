"""Matrix shapes, sums, products, start matrices and skewed joins against numpy."""

import numpy as np
import pytest
from matrix_tools import array_of, entries_of
from pyspark.sql import functions as F

import eigenloom as el
from eigenloom.functions.seeds import mixed
from eigenloom.operators.blocks import SparseBlock
from eigenloom.operators.skew import hot_keys, salted_join

RNG = np.random.default_rng(3)
A = np.where(RNG.random((25, 9)) < 0.4, RNG.standard_normal((25, 9)), 0.0)
M = RNG.standard_normal((9, 3))


def factor_of(spark, m):
    cells = [(i, j, float(x)) for (i, j), x in np.ndenumerate(m)]
    return el.pack(spark.createDataFrame(cells, "col_id int, comp int, value double"), "col_id", m.shape[1])


def vectors_of(packed, key, shape):
    out = np.zeros(shape)
    for r in packed.collect():
        out[r[key]] = r["vec"]
    return out


def test_shapes_round_trip(spark):
    entries = entries_of(spark, A)
    rows = el.to_rows(entries)
    assert np.allclose(array_of(el.to_entries(rows), A.shape), A)
    for r in rows.collect():
        assert list(r["indices"]) == sorted(r["indices"]) and r["segment"] == 0
    assert el.dimensions(rows) == (len(A[A.any(axis=1)]), 9)
    assert el.dimensions(entries) == (len(A[A.any(axis=1)]), 9)


def test_rows_wider_than_a_segment(spark):
    """Cells past the first segment count as rows and columns, and drop out under a narrower cap."""
    far = 3 * (1 << 20) + 5
    cells = [(0, 1, 2.0), (0, far, 1.0), (1, far, 4.0), (2, 0, 1.0), (2, 1, 3.0)]
    rows = el.to_rows(spark.createDataFrame(cells, "row_id long, col_id int, value double"))
    assert sorted((r["row_id"], r["segment"]) for r in rows.collect()) == [(0, 0), (0, 3), (1, 3), (2, 0)]
    assert el.dimensions(rows) == (3, far + 1)
    near = np.array([[0.0, 2.0], [0.0, 0.0], [1.0, 3.0]])
    sigma = np.linalg.svd(near - near.mean(axis=0), compute_uv=False)
    for limit in (64 << 20, 0):
        fit = el.sketch_pca(rows, 2, max_iter=1, n_rows=3, n_cols=2, limit=limit)
        assert np.allclose(fit.sigma, sigma[:1])
    assert el.column_sums(rows, 2).agg(F.sum("value")).first()[0] == 6


def test_repeated_entries_add_up(spark):
    twice = entries_of(spark, A).unionByName(entries_of(spark, A))
    rows = el.to_rows(twice)
    assert np.allclose(array_of(el.to_entries(rows), A.shape), 2 * A)
    assert rows.count() == A.any(axis=1).sum()
    gone = entries_of(spark, A).unionByName(entries_of(spark, -A))
    left = el.to_rows(gone)
    assert left.count() == rows.count() and left.where(F.size("indices") > 0).count() == 0


def test_filters(spark):
    entries = entries_of(spark, A).unionByName(
        spark.createDataFrame([(0, 1, 0.0)], "row_id long, col_id int, value double")
    )
    capped = np.where(np.arange(9) < 5, A, 0)
    for table in (entries, el.to_rows(entries)):
        kept = el.cap_columns(table, 5)
        cells = el.to_entries(kept) if "indices" in kept.columns else kept
        assert np.allclose(array_of(cells, A.shape), capped)
        assert cells.where("value = 0").count() == 0
    assert el.limit_columns(entries, 5).agg(F.max("col_id")).first()[0] == 5
    assert el.rebase_columns(entries, 1).agg(F.max("col_id")).first()[0] == 7


def test_sampled_rows_are_whole_and_stable(spark):
    wide = el.entries_from(
        spark.range(20000).select(F.floor(F.col("id") / 4).alias("r"), (F.col("id") % 4).alias("c"), F.lit(1.0).alias("v")),
        "r", "c", "v",
    )
    kept = el.sample_rows(wide, 0.3, seed=4)
    per_row = kept.groupBy("row_id").count()
    assert per_row.where("count <> 4").count() == 0
    n = per_row.count()
    assert abs(n - 1500) < 4 * np.sqrt(5000 * 0.3 * 0.7)
    again = el.sample_rows(wide.repartition(13), 0.3, seed=4)
    assert again.exceptAll(kept).count() == 0 and again.count() == kept.count()
    assert el.sample_rows(wide, 0.3, seed=5).exceptAll(kept).count() > 0
    assert el.sample_rows(wide, 1.0).count() == 20000 and el.sample_rows(wide, 0.0).count() == 0
    with pytest.raises(ValueError):
        el.sample_rows(wide, 1.5)


def test_sums(spark):
    entries, rows = entries_of(spark, A), el.to_rows(entries_of(spark, A))
    for sums in (el.column_sums(entries), el.column_sums(rows), el.column_sums(rows, 9)):
        assert np.allclose(array_of(sums.withColumn("z", F.lit(0)), (9, 1), "col_id", "z")[:, 0], A.sum(axis=0))
    for table in (entries, rows):
        sums = el.column_abs_sums(table).withColumn("z", F.lit(0))
        assert np.allclose(array_of(sums, (9, 1), "col_id", "z")[:, 0], np.abs(A).sum(axis=0))
        assert np.isclose(el.total_variation(table, 40).first()["value"], (A**2).sum() - (A.sum(axis=0) ** 2).sum() / 40)
    means = el.column_means(entries, 40, 11).withColumn("z", F.lit(0))
    assert means.count() == 11
    assert np.allclose(array_of(means, (11, 1), "col_id", "z")[:9, 0], A.sum(axis=0) / 40)
    assert np.allclose(array_of(el.matrix_sum(entries, rows, entries), A.shape), 3 * A)
    assert np.isclose(el.trace(entries).first()["value"], np.trace(A))


def test_products(spark):
    entries, rows = entries_of(spark, A), el.to_rows(entries_of(spark, A))
    factor = factor_of(spark, M)
    for table, limit in ((rows, 1 << 20), (entries, 1 << 20), (rows, 0), (entries, 0)):
        scores = el.project_rows(table, factor, 9, 3, limit)
        assert np.allclose(vectors_of(scores, "row_id", (25, 3)), A @ M)
    means = el.column_means(entries, 25, 9)
    zm = A.mean(axis=0) @ M
    found = {r["comp"]: r["value"] for r in el.mean_times_matrix(means, factor, 3).collect()}
    assert np.allclose([found[j] for j in range(3)], zm)
    full = el.reconstruct_rows(scores, factor, 9, 3, means)
    present = A.any(axis=1)
    wanted = np.where(present[:, None], A @ M @ M.T + A.mean(axis=0), 0)
    assert np.allclose(array_of(full, A.shape), wanted)
    rest = el.row_residual(scores, factor, entries, 9, 3, means)
    assert np.allclose(array_of(rest, A.shape), np.where(present[:, None], A @ M @ M.T - A - A.mean(axis=0), 0))
    cross = el.cross_product(entries, scores, zm)
    z = A @ M
    assert np.allclose(vectors_of(cross, "col_id", (9, 3)), A.T @ (z - zm))
    excess = z[present].sum(axis=0) - 25 * zm
    fixed = el.mean_correction(cross, means, excess)
    assert np.allclose(vectors_of(fixed, "col_id", (9, 3)), (A - A.mean(axis=0)).T @ (z - zm))
    zc = z[present] - zm
    assert np.allclose(vectors_of(el.gram(scores, zm), "i", (3, 3)), zc.T @ zc)
    for fan_in in (2, 3):
        r = vectors_of(el.tsqr_r(scores.repartition(9), zm, fan_in), "i", (3, 3))
        assert np.allclose(r.T @ r, zc.T @ zc) and np.allclose(r, np.triu(r)) and (np.diag(r) >= 0).all()


def test_reconstruction_from_all_components(spark):
    fit_rows = el.to_rows(entries_of(spark, A))
    v = np.linalg.svd(A, full_matrices=False)[2].T
    factor = factor_of(spark, v)
    scores = el.project_rows(fit_rows, factor, 9, 9)
    assert np.allclose(array_of(el.reconstruct_rows(scores, factor, 9, 9), A.shape), A)
    rest = el.row_residual(scores, factor, fit_rows, 9, 9)
    assert np.allclose(array_of(rest, A.shape), 0)


def test_centered_rows(spark):
    rows = el.to_rows(entries_of(spark, A)).where(F.size("indices") > 0)
    mu = A.mean(axis=0)
    wanted = np.where(A.any(axis=1)[:, None], A - mu, 0)
    assert np.allclose(array_of(el.center_rows(rows, mu), A.shape), wanted)


def test_block_kernels():
    """Sparse, dense and uneven blocks, with empty rows and every chunk size."""
    for fill in (0.01, 0.3, 1.0):
        array = np.where(RNG.random((200, 150)) < fill, RNG.standard_normal((200, 150)), 0.0)
        array[10] = 0
        array[11] = 1.0
        lengths = (array != 0).sum(axis=1)
        row, index = np.nonzero(array)
        block = SparseBlock(lengths, index, array[row, index])
        factor = RNG.standard_normal((150, 4))
        into = np.zeros((4, 150))
        scores = np.zeros((200, 4))
        for max_cells in (7, 1000, 1 << 20):
            into[:] = 0
            for start, part in block.chunks(max_cells=max_cells):
                scores[start : start + len(part)] = part.times(factor)
                part.add_cross(scores[start : start + len(part)], into)
            assert np.allclose(scores, array @ factor)
            assert np.allclose(into.T, array.T @ (array @ factor))
        cut = block.below(60)
        assert np.allclose(cut.dense(60), array[:, :60])
        covered = sum(len(part) for _, part in block.pieces(150, 4))
        assert covered == 200


def test_start_matrices(spark):
    cols = el.column_range(spark, 4000)
    g = array_of(el.gaussian_seed(cols, 5, seed=2), (4000, 5), "col_id", "comp")
    assert abs(g.mean()) < 0.03 and abs(g.std() - 1) < 0.03
    assert np.abs(np.corrcoef(g.T) - np.eye(5)).max() < 0.06
    assert abs((g**4).mean() - 3) < 0.3
    u = array_of(el.uniform_seed(cols, 5, seed=2), (4000, 5), "col_id", "comp")
    assert u.min() > 0 and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.003
    some = el.gaussian_seed(cols.repartition(3).where("col_id % 7 = 3"), 5, seed=2)
    for r in some.collect():
        assert g[r["col_id"], r["comp"]] == r["value"]
    other = array_of(el.gaussian_seed(cols, 5, seed=3), (4000, 5), "col_id", "comp")
    assert abs(np.corrcoef(g.ravel(), other.ravel())[0, 1]) < 0.03
    v = array_of(el.validation_seed(el.column_range(spark, 12), 3), (12, 3), "col_id", "comp")
    assert np.array_equal(v, (np.arange(12)[:, None] + np.arange(3)) % 10 + 1)
    assert len({mixed(x) for x in range(10000)}) == 10000


def test_skewed_join(spark):
    """A third of the rows on one key: it is split, the result is that of a plain join."""
    big = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("x")
    )
    small = spark.range(-1, 400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    hot = hot_keys(big, "k")
    assert [r["k"] for r in hot.table.collect()] == [-1]
    joined = salted_join(big, small, "k", "x")
    plain = big.join(small, "k")
    assert joined.count() == plain.count() and joined.exceptAll(plain).count() == 0
    even = big.where("k >= 0")
    assert hot_keys(even, "k").table is None
    assert salted_join(even, small, "k", "x").exceptAll(even.join(small, "k")).count() == 0
    assert hot_keys(big.where("x < 0"), "k").table is None


def test_skewed_products(spark):
    """One column and one row hold most of the cells."""
    array = np.zeros((60, 40))
    array[:, 3] = RNG.standard_normal(60)
    array[7] = RNG.standard_normal(40)
    entries, m = entries_of(spark, array), RNG.standard_normal((40, 2))
    scores = el.project_rows(entries, factor_of(spark, m), 40, 2, limit=0)
    assert np.allclose(vectors_of(scores, "row_id", (60, 2)), array @ m)
    cross = el.cross_product(entries, scores, np.zeros(2))
    assert np.allclose(vectors_of(cross, "col_id", (40, 2)), array.T @ (array @ m))
    centred = array - array.mean(axis=0)
    sigma = np.linalg.svd(centred, compute_uv=False)
    fit = el.sketch_pca(entries, 2, oversample=10, max_iter=3, n_rows=60, n_cols=40, limit=0)
    assert np.allclose(fit.sigma, sigma[:2])
