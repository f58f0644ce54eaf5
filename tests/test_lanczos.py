"""Exact components without a covariance: wide matrices, repeated values, low rank, absent rows, bounds."""

import numpy as np
import pytest
from matrix_tools import array_of, components_of, entries_of

import eigenloom as el

RNG = np.random.default_rng(12)


def leading(array, k):
    _, sigma, w = np.linalg.svd(array - array.mean(axis=0), full_matrices=False)
    return sigma[:k], w[:k].T


def wide(n_rows, n_cols):
    """Groups of rows with columns of their own, one weaker than the other, and noise."""
    array = np.zeros((n_rows, n_cols))
    for i in range(n_rows):
        own = (np.arange(30) * 12 + i % 12) * 7 % n_cols
        array[i, own] = 0.8 ** (i % 12) * (1 + 0.1 * RNG.normal(size=30))
        array[i, RNG.integers(0, n_cols, 5)] = 0.1
    return array


def test_wide_matrix_agrees_with_numpy(spark):
    array = wide(240, 20_000)
    rows = el.to_rows(entries_of(spark, array, 3)).cache()
    with pytest.raises(ValueError, match="covariance"):
        el.exact_pca(rows, k=4, n_cols=20_000)
    fit = el.exact_pca(rows, k=4, n_cols=20_000, method="lanczos")
    sigma, w = leading(array, 4)
    assert fit.converged and fit.n_rows == 240
    np.testing.assert_allclose(fit.sigma, sigma, rtol=1e-8)
    found = components_of(fit, 20_000)
    np.testing.assert_allclose(np.abs((found * w).sum(axis=0)), 1, atol=1e-8)
    np.testing.assert_allclose(found.T @ found, np.eye(4), atol=1e-10)
    rows.unpersist()


def test_restarts_keep_what_was_found(spark, monkeypatch):
    array = RNG.normal(size=(60, 50)) * 0.9 ** np.arange(50)
    monkeypatch.setattr("eigenloom.plans.lanczos.FULL", 3)
    fit = el.exact_pca(entries_of(spark, array), k=2, n_cols=50, method="lanczos")
    assert fit.converged and fit.passes > 3
    np.testing.assert_allclose(fit.sigma, leading(array, 2)[0], rtol=1e-8)


def test_repeated_values_and_absent_rows(spark):
    array = np.zeros((40, 30))
    array[np.arange(12), np.arange(12)] = 5.0
    array[12, 20] = 1.0
    fit = el.exact_pca(entries_of(spark, array), k=8, n_rows=40, n_cols=30, method="lanczos")
    np.testing.assert_allclose(fit.sigma, leading(array, 8)[0], rtol=1e-8)


def test_low_rank_and_one_column(spark):
    array = np.outer(RNG.normal(size=9), RNG.normal(size=6))
    with pytest.warns(UserWarning, match="rank 1"):
        fit = el.exact_pca(entries_of(spark, array), k=3, n_cols=6, method="lanczos")
    np.testing.assert_allclose(fit.sigma, leading(array, 1)[0], rtol=1e-8)
    assert array_of(fit.components, (6, 1), "col_id", "comp").shape == (6, 1)
    one = el.exact_pca(entries_of(spark, array[:, :1]), k=1, n_cols=1, method="lanczos")
    np.testing.assert_allclose(one.sigma, leading(array[:, :1], 1)[0], rtol=1e-8)


def test_bounds_and_warnings(spark):
    array = RNG.normal(size=(30, 25))
    entries = entries_of(spark, array)
    with pytest.raises(ValueError, match="basis"):
        el.exact_pca(entries, k=2, n_cols=25, method="lanczos", covariance_bytes=1000)
    with pytest.raises(ValueError, match="method"):
        el.exact_pca(entries, k=2, n_cols=25, method="power")
    with pytest.warns(UserWarning, match="settle"):
        fit = el.exact_pca(entries, k=2, n_cols=25, method="lanczos", max_scans=1)
    assert not fit.converged
    with pytest.raises(ValueError, match="zero"), pytest.warns(UserWarning, match="rank 0"):
        el.exact_pca(entries_of(spark, np.ones((4, 3))), k=1, n_cols=3, method="lanczos")
