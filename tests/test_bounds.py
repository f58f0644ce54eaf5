"""Upper bounds of the residual norm: the stated rate over many seeds, both forms of a factor, odd input."""

import numpy as np
import pytest
from matrix_tools import entries_of

import eigenloom as el
from eigenloom.plans.residual import norm_bound_in

RNG = np.random.default_rng(77)


class Arrays:
    """The steps of a space on a centred array in memory."""

    noise = 0.0

    def __init__(self, array):
        self.array = array

    def start(self, width, seed):
        return np.random.default_rng(seed).normal(size=(self.array.shape[1], width))

    def keep_only(self, *factors):
        pass

    def inner(self, left, right):
        return left.T @ right

    def less(self, factor, other, small):
        return factor - other @ small

    def times(self, factor, small):
        return factor @ small

    def sketch(self, factor, cross=True):
        z = self.array @ factor
        return self.array.T @ z, z.T @ z


def shares(array, v, failure, probes, power, seeds=200):
    norm = np.linalg.norm(array - array @ v @ v.T, 2)
    bounds = [norm_bound_in(Arrays(array), v, failure, probes, power, seed) for seed in range(seeds)]
    return np.array(bounds) / norm


def test_the_stated_rate_holds_and_is_not_idle():
    # One direction left over is the worst case: there the rate is nearly met.
    v = np.linalg.qr(RNG.normal(size=(40, 3)))[0]
    rest = RNG.normal(size=40)
    rest -= v @ (v.T @ rest)
    array = np.outer(RNG.normal(size=90), rest) + RNG.normal(size=(90, 3)) @ v.T * 9
    for power in (0, 1):
        below = int((shares(array, v, 0.2, 1, power) < 1).sum())
        assert 15 <= below <= 57, below  # 40 expected, three standard deviations on top
    assert (shares(array, v, 1e-3, 10, 2) >= 1).all()


def test_powers_bring_the_bound_nearer():
    array = RNG.normal(size=(300, 80))
    v = np.linalg.svd(array)[2][:4].T
    far, near, nearer = (shares(array, v, 1e-3, 10, power, 40) for power in (0, 2, 5))
    assert (far >= 1).all() and (near >= 1).all() and (nearer >= 1).all()
    assert far.mean() > 2 * near.mean() and near.mean() > nearer.mean() and nearer.max() < 1.25


def test_bound_of_stored_components(spark):
    array = RNG.normal(size=(50, 12)) + 3
    entries = entries_of(spark, array, 2)
    fit = el.sketch_pca(entries, k=3, n_cols=12, n_rows=60)
    whole = np.vstack([array, np.zeros((10, 12))])
    whole = whole - whole.mean(axis=0)
    v = np.zeros((12, 3))
    for r in fit.components.collect():
        v[r.col_id, r.comp] = r.value
    norm = np.linalg.norm(whole - whole @ v @ v.T, 2)
    local = el.residual_norm_bound(entries, fit.components, 3, n_cols=12, n_rows=60)
    stored = el.residual_norm_bound(entries, fit.components, 3, n_cols=12, n_rows=60, limit=0)
    assert norm <= local < 1.8 * norm
    np.testing.assert_allclose(stored, local, rtol=1e-8)
    error = el.relative_spectral_bound(entries, fit.components, 3, norm, n_cols=12, n_rows=60)
    np.testing.assert_allclose(error, local / norm - 1)


def test_nothing_left_and_bad_options(spark):
    array = np.outer(np.arange(8.0), np.ones(4))
    entries = entries_of(spark, array)
    fit = el.sketch_pca(entries, k=1, n_rows=8, n_cols=4)
    assert el.residual_norm_bound(entries, fit.components, 1, n_rows=8, n_cols=4) < 1e-3
    for wrong in ({"failure": 0}, {"failure": 1}, {"probes": 0}, {"power": -1}):
        with pytest.raises(ValueError, match="failure"):
            el.residual_norm_bound(entries, fit.components, 1, n_cols=4, **wrong)
