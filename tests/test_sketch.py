"""Fits against numpy on generated matrices: layouts, absent rows, edge cases, both spaces."""

import numpy as np
import pytest
from matrix_tools import components_of, entries_of

import eigenloom as el

RNG = np.random.default_rng(5)


def low_rank(n, d, rank, sparse=0.3):
    """A sparse matrix with well separated leading singular values."""
    base = RNG.standard_normal((n, rank)) * 3.0 ** -np.arange(rank) * 20
    full = base @ RNG.standard_normal((rank, d)) + 0.01 * RNG.standard_normal((n, d)) + 1.0
    return np.where(RNG.random((n, d)) < sparse, full, 0.0)


def exact(array):
    centred = array - array.mean(axis=0)
    _, sigma, vt = np.linalg.svd(centred, full_matrices=False)
    return centred, sigma, vt.T


def same_up_to_sign(a, b, tol=1e-6):
    return np.allclose(np.abs(np.sum(a * b, axis=0)), 1, atol=tol)


MATRIX = low_rank(60, 12, 4, sparse=0.9)
MATRIX[[3, 17, 40]] = 0.0  # rows without a stored cell
MATRIX[:, 7] = 0.0


@pytest.mark.parametrize("method", ["fused", "two_pass", "tsqr"])
@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_absent_rows_full_width(spark, method, limit):
    _, sigma, v = exact(MATRIX)
    fit = el.sketch_pca(
        entries_of(spark, MATRIX), 3, oversample=9, max_iter=1, method=method, n_rows=60, n_cols=12, limit=limit
    )
    assert np.allclose(fit.sigma, sigma[:3], rtol=1e-9)
    assert same_up_to_sign(components_of(fit, 12), v[:, :3])


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_layouts(spark, parts):
    _, sigma, _ = exact(MATRIX)
    rows = el.to_rows(entries_of(spark, MATRIX)).repartition(parts)
    fit = el.sketch_pca(rows, 2, oversample=4, max_iter=6, n_rows=60, n_cols=12)
    assert np.allclose(fit.sigma, sigma[:2], rtol=1e-6)
    first = test_layouts.__dict__.setdefault("first", components_of(fit, 12))
    assert np.allclose(first, components_of(fit, 12), atol=1e-9)


def test_both_spaces_take_the_same_steps(spark):
    options = dict(oversample=1, max_iter=1, n_rows=60, n_cols=12)
    local = el.sketch_pca(entries_of(spark, MATRIX), 2, **options)
    table = el.sketch_pca(entries_of(spark, MATRIX), 2, limit=0, **options)
    assert np.allclose(local.sigma, table.sigma, rtol=1e-9)
    assert np.allclose(components_of(local, 12), components_of(table, 12), atol=1e-8)


def test_residual_identity(spark):
    centred, sigma, _ = exact(MATRIX)
    entries = entries_of(spark, MATRIX)
    dims = dict(n_rows=60, n_cols=12)
    fit = el.sketch_pca(entries, 3, oversample=9, max_iter=1, **dims)
    v = components_of(fit, 12)
    left = centred - centred @ v @ v.T
    assert np.isclose((centred**2).sum() - (fit.sigma**2).sum(), (left**2).sum())
    total = el.total_variation(entries, 60).first()["value"]
    assert np.isclose(total, (sigma**2).sum())
    for limit in (64 << 20, 0):
        norm = el.residual_spectral_norm(entries, fit.components, 3, limit=limit, norm_iter=20, **dims)
        assert abs(norm - sigma[3]) < 1e-3


def test_stored_components_are_taken_as_they_are(spark):
    """Half-length components leave more behind than their span would."""
    centred, sigma, v = exact(MATRIX)
    half = [(j, 0, float(v[j, 0] / 2)) for j in range(12)]
    components = spark.createDataFrame(half, "col_id int, comp int, value double")
    dims = dict(n_rows=60, n_cols=12, norm_iter=40)
    entries = entries_of(spark, MATRIX)
    norm, error = el.evaluate_components(entries, components, 1, float(sigma[1]), **dims)
    halved = v[:, :1] / 2
    wanted = np.linalg.norm(centred @ (np.eye(12) - halved @ halved.T), 2)
    assert norm > 1.2 * sigma[1] and norm <= wanted + 1e-3
    assert error == pytest.approx((norm - sigma[1]) / sigma[1])
    spanned = el.residual_spectral_norm(entries, components, 1, **dims)
    assert abs(spanned - sigma[1]) < 1e-3


def test_tolerance_loop(spark):
    entries = entries_of(spark, MATRIX)
    dims = dict(n_rows=60, n_cols=12)
    fit = el.fit_until_tolerance(entries, 3, tolerance=0.02, oversample=2, norm_iter=30, **dims)
    assert fit.errors[-1] <= 0.02 and fit.passes == len(fit.errors) == len(fit.pass_seconds)
    once = el.sketch_pca(entries, 3, max_iter=2, oversample=2, **dims)
    assert once.passes == 2 and not once.errors
    with pytest.raises(ValueError):
        el.sketch_pca(entries, 3, next_sigma=0.0, **dims)


@pytest.mark.parametrize("method", ["fused", "two_pass", "tsqr"])
@pytest.mark.parametrize("mean", [3.0, 1e6])
def test_means_that_outweigh_the_spread(spark, method, mean):
    """Centred after the sums where that is safe, before them where it is not."""
    array = RNG.standard_normal((80, 6)) * [5, 4, 3, 2, 1, 0.5] + mean
    _, sigma, v = exact(array)
    rows = el.to_rows(entries_of(spark, array))
    fit = el.sketch_pca(rows, 3, oversample=3, max_iter=1, method=method, n_cols=6)
    assert fit.n_rows == 80
    assert np.allclose(fit.sigma, sigma[:3], rtol=1e-8)
    assert same_up_to_sign(components_of(fit, 6), v[:, :3])


def test_wide_and_short(spark):
    """Fewer rows than sketch columns, and a matrix wider than a dense block."""
    array = np.zeros((6, 5000))
    for i in range(6):
        array[i, RNG.integers(0, 5000, 40)] = RNG.standard_normal(40) * 2.0**-i
    _, sigma, v = exact(array)
    fit = el.sketch_pca(entries_of(spark, array), 4, oversample=10, max_iter=2, n_rows=6, n_cols=5000)
    assert np.allclose(fit.sigma, sigma[:4], rtol=1e-8)
    assert same_up_to_sign(components_of(fit, 5000), v[:, :4])


def test_long_and_uneven_rows(spark):
    """A few full rows among many sparse ones: grouped by length, same products."""
    array = np.where(RNG.random((300, 700)) < 0.004, RNG.standard_normal((300, 700)), 0.0)
    array[5] = RNG.standard_normal(700) * 5
    array[77] = RNG.standard_normal(700) * 3
    _, sigma, _ = exact(array)
    fit = el.sketch_pca(entries_of(spark, array), 2, oversample=8, max_iter=6, n_rows=300, n_cols=700)
    assert np.allclose(fit.sigma, sigma[:2], rtol=1e-6)


def test_equal_singular_values(spark):
    array = np.vstack([np.eye(4), -np.eye(4)])
    fit = el.sketch_pca(entries_of(spark, array), 3, oversample=1, max_iter=1)
    v = components_of(fit, 4)
    assert np.allclose(fit.sigma, np.sqrt(2)) and np.allclose(v.T @ v, np.eye(3))


def test_edges(spark):
    entries = entries_of(spark, MATRIX)
    with pytest.raises(ValueError, match="k=13"):
        el.sketch_pca(entries, 13, n_rows=60, n_cols=12)
    fit = el.sketch_pca(entries, 12, oversample=0, max_iter=1, n_rows=60, n_cols=12)
    assert len(fit.sigma) == 11  # all columns asked for: one fewer given
    with pytest.raises(ValueError, match="holds 57"):
        el.sketch_pca(entries, 2, n_rows=50)
    with pytest.raises(ValueError, match="holds 57"):
        el.sketch_pca(entries, 2, max_iter=1, n_rows=50, n_cols=12)
    empty = spark.createDataFrame([], "row_id long, col_id int, value double")
    with pytest.raises(ValueError, match="empty"):
        el.sketch_pca(empty, 1)
    constant = entries_of(spark, np.full((5, 3), 2.5))
    for limit in (64 << 20, 0):
        with pytest.raises(ValueError, match="centred matrix is zero"):
            el.sketch_pca(constant, 1, max_iter=1, limit=limit)
    with pytest.raises(ValueError, match="method"):
        el.sketch_pca(entries, 1, method="other")


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_either_id_type(spark, limit):
    _, sigma, v = exact(MATRIX)
    swapped = entries_of(spark, MATRIX).selectExpr(
        "CAST(row_id AS INT) AS row_id", "CAST(col_id AS BIGINT) AS col_id", "value"
    )
    fit = el.sketch_pca(swapped, 2, oversample=10, max_iter=1, n_rows=60, n_cols=12, limit=limit)
    assert np.allclose(fit.sigma, sigma[:2])
    components = fit.components.withColumn("col_id", fit.components.col_id.cast("bigint"))
    norm = el.residual_spectral_norm(swapped, components, 2, n_rows=60, n_cols=12, limit=limit)
    assert abs(norm - sigma[2]) < 1e-3


def test_bad_values(spark):
    bad = entries_of(spark, np.array([[1.0, 2.0], [np.nan, 1.0], [0.5, np.inf]]))
    with pytest.raises(ValueError, match="NaN or infinite"):
        el.sketch_pca(bad, 1, max_iter=1)


def test_table_steps_are_cleaned_up(spark):
    import os
    from urllib.parse import urlparse

    from eigenloom.session import scratch_root

    root = urlparse(scratch_root(spark)).path
    before = set(os.listdir(root)) if os.path.exists(root) else set()
    fit = el.sketch_pca(entries_of(spark, MATRIX), 2, max_iter=2, n_rows=60, n_cols=12, limit=0)
    left = set(os.listdir(root)) - before
    assert len([name for name in left if name.startswith("eigenloom-")]) == 1  # the components
    assert fit.components.count() == 24


def test_columns_beyond_the_declared_width_are_dropped(spark):
    _, sigma, _ = exact(MATRIX[:, :5])
    for limit in (64 << 20, 0):
        fit = el.sketch_pca(
            entries_of(spark, MATRIX), 2, oversample=3, max_iter=1, n_rows=60, n_cols=5, limit=limit
        )
        assert np.allclose(fit.sigma, sigma[:2])


def test_one_column_and_one_row(spark):
    column = entries_of(spark, np.array([[1.0], [2.0], [4.0]]))
    fit = el.sketch_pca(column, 1, max_iter=1)
    assert np.allclose(fit.sigma, [np.sqrt(((np.array([1, 2, 4]) - 7 / 3) ** 2).sum())])
    with pytest.raises(ValueError, match="zero"):
        el.sketch_pca(entries_of(spark, np.array([[1.0, 2.0]])), 1, max_iter=1)


def test_exact_pca_counts_absent_rows(spark):
    _, sigma, v = exact(MATRIX)
    fit = el.exact_pca(entries_of(spark, MATRIX), 3, n_rows=60, n_cols=12)
    assert np.allclose(fit.sigma, sigma[:3])
    assert same_up_to_sign(components_of(fit, 12), v[:, :3])


def test_randomized_preset(spark):
    _, sigma, _ = exact(MATRIX)
    fit = el.randomized_pca(entries_of(spark, MATRIX), 2, p=4, q=3, n_rows=60, n_cols=12)
    assert fit.passes == 4 and np.allclose(fit.sigma, sigma[:2], rtol=1e-4)


def test_sparse_query_against_brute_force(spark):
    """The order-by-part fit at sf0.001 is a power sketch: close to, never above, the true values."""
    from eigenloom.workload import fixtures as fx
    from eigenloom.workload.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    n_rows, n_cols = fx.order_part_dims(spark, sf)
    array = np.zeros((n_rows, n_cols))
    for r in fx.order_part(spark, sf).collect():
        array[r["row_id"], r["col_id"]] += r["value"]
    sigma = np.linalg.svd(array - array.mean(axis=0), compute_uv=False)
    found = [r["sigma"] for r in QUERIES["sketch_pca_sparse"](spark, sf).sort("comp").collect()]
    assert (np.array(found) <= sigma[:3] + 1e-3).all()
    assert (np.array(found) >= 0.93 * sigma[:3]).all()
