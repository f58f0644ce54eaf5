"""The 7 x 5 example matrix, with values known in closed form."""

import numpy as np
import pytest
from matrix_tools import array_of, components_of, entries_of

import eigenloom as el
from eigenloom.plans.spaces import LocalSpace, TableSpace

MAT = np.array(
    [
        [0, 1, 0, 1, 0],
        [1, 1, 0, 1, 0],
        [0, 0, 1, 1, 0],
        [1, 0, 1, 1, 0],
        [0, 1, 0, 1, 0],
        [1, 1, 0, 1, 0],
        [0, 0, 1, 1, 0],
    ],
    dtype=float,
)
SIGMA = np.sqrt((36 + np.array([1, -1]) * np.sqrt(176)) / 14)
MU = np.array([3 / 7, 4 / 7, 3 / 7, 1, 0])
CROSS = np.array([[10, 22], [-10, -8], [10, 8], [0, 0], [0, 0]]) / 7
GRAM = np.array([[20, 30], [30, 52]]) / 7


@pytest.fixture(scope="module")
def matrix(spark):
    return entries_of(spark, MAT)


def test_means_and_scores(spark, matrix):
    means = el.column_means(matrix, 7, 5)
    assert np.allclose([r["value"] for r in means.sort("col_id").collect()], MU)
    factor = el.pack(el.validation_seed(el.column_range(spark, 5), 2), "col_id", 2)
    wanted = [[6, 8], [7, 10], [7, 9], [8, 11], [6, 8], [7, 10], [7, 9]]
    for table in (matrix, el.to_rows(matrix)):
        scores = el.project_rows(table, factor, 5, 2).sort("row_id").collect()
        assert [list(r["vec"]) for r in scores] == wanted


@pytest.mark.parametrize("kind", [LocalSpace, TableSpace])
def test_one_pass_sums(spark, matrix, kind):
    space = kind(matrix, 7, 5)
    factor = space.load(el.validation_seed(el.column_range(spark, 5), 2), 2)
    cross, gram = space.sketch(factor)
    assert np.allclose(gram, GRAM)
    assert np.allclose(array_of(space.table(cross), (5, 2), "col_id", "comp"), CROSS)
    r = space.stack_r(factor)
    assert np.allclose(r.T @ r, GRAM)
    assert (np.diag(r) >= 0).all()
    space.close()


@pytest.mark.parametrize("method", ["fused", "two_pass", "tsqr"])
@pytest.mark.parametrize("width, limit", [(3, 64 << 20), (5, 64 << 20), (3, 0)])
def test_rank_two(matrix, method, width, limit):
    options = dict(max_iter=2, method=method, n_rows=7, n_cols=5, limit=limit)
    with pytest.warns(UserWarning, match="rank 2"):
        fit = el.sketch_pca(matrix, 3, oversample=width - 3, **options)
    v = components_of(fit, 5)
    assert np.allclose(fit.sigma, SIGMA)
    assert np.allclose(v.T @ v, np.eye(2))
    assert v[1, 0] > 0 and v[0, 1] > 0  # the first of the largest entries is positive


def test_norms(matrix):
    fit = el.sketch_pca(matrix, 1, oversample=4, max_iter=1, n_cols=5)
    norm = el.residual_spectral_norm(matrix, fit.components, 1, n_cols=5)
    assert norm == round(SIGMA[1], 4) == el.kth_singular_value(matrix, 2, n_cols=5)
    assert el.kth_singular_value(matrix, 3, n_cols=5) == 0
    assert el.relative_spectral_error(matrix, fit.components, 1, n_cols=5) == 0
    with pytest.warns(UserWarning):
        full = el.sketch_pca(matrix, 3, oversample=2, max_iter=1, n_cols=5)
    assert el.residual_spectral_norm(matrix, full.components, 2, n_cols=5) == 0
    with pytest.raises(ValueError, match="next singular value"):
        el.relative_spectral_error(matrix, full.components, 2, n_cols=5)


def test_exact(matrix):
    fit = el.exact_pca(matrix, 2, n_cols=5)
    sketched = el.sketch_pca(matrix, 2, oversample=3, max_iter=2, n_cols=5)
    assert np.allclose(fit.sigma, SIGMA)
    assert np.allclose(components_of(fit, 5), components_of(sketched, 5))
