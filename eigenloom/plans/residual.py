"""Singular values, and how much of a matrix a set of components leaves unexplained."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .spaces import RANK_TOLERANCE, declared, opened


# Added to the seed of probes for a bound, so that they are independent of a fit with the same seed.
BOUND_SEED = 1_000_003


def whitener(gram: np.ndarray) -> np.ndarray:
    """T with T'(gram)T = I on the numerical range of a Gram matrix."""
    if not np.isfinite(gram).all():
        raise ValueError("the matrix holds NaN or infinite values")
    power, w = np.linalg.eigh(gram)
    keep = power > RANK_TOLERANCE * max(power[-1], 0.0)
    return (w[:, keep] / np.sqrt(power[keep]))[:, ::-1]


def settled(value: float, decimals: int) -> float:
    """Half-up rounding to fixed decimals, on which the stop rules compare."""
    return math.floor(value * 10.0**decimals + 0.5) / 10.0**decimals


def same(new: float, old: float, rtol: float | None) -> bool:
    return new == old or (rtol is not None and abs(new - old) <= rtol * abs(new))


@dataclass(frozen=True)
class Stop:
    """How a norm or a singular value is refined: extra sketch columns, passes at most, start seed.

    Passes end early once the value repeats at ``decimals``, or moves by less than ``rtol``.
    """

    oversample: int = 10
    norm_iter: int = 10
    seed: int = 0
    decimals: int = 4
    rtol: float | None = None


class Measure(float):
    """A number refined by passes; ``converged`` tells whether it settled before they ran out."""

    converged: bool

    def __new__(cls, value: float, converged: bool = True) -> Measure:
        number = super().__new__(cls, value)
        number.converged = converged
        return number


def unsettled(value: float, what: str, passes: int) -> Measure:
    warnings.warn(f"{what} did not settle in {passes} passes; allow more of them with norm_iter")
    return Measure(value, False)


def residual_norm_in(space, v, stop: Stop) -> Measure:
    """Spectral norm of Yc (I - V V') by power passes on a sketch held orthogonal to V."""
    factor, norm = space.start(min(1 + stop.oversample, space.n_cols), stop.seed), 0.0
    for _ in range(stop.norm_iter):
        factor = space.less(factor, v, space.inner(v, factor))
        y_cross, z_gram = space.sketch(factor)
        basis = whitener(z_gram)
        if not basis.shape[1]:
            return Measure(0.0)
        left = space.times(y_cross, basis)
        left = space.less(left, v, space.inner(v, left))
        factor, sigma = space.svd(left)
        space.keep_only(v, factor)
        new = settled(float(sigma[0]), stop.decimals) if len(sigma) else 0.0
        if same(new, norm, stop.rtol):
            return Measure(new)
        norm = new
    return unsettled(norm, "the residual norm", stop.norm_iter)


def norm_bound_in(space, v, failure: float, probes: int, power: int, seed: int) -> float:
    """An upper bound of the norm of E = Yc (I - V V') from what E (E'E)^power does to independent normal probes.

    The norm of any matrix is at most a sqrt(2 / pi) times the longest image of r such probes, but for a chance
    of a^-r at most. It is taken for the odd power of E, whose norm is that power of E's: the root of it brings the
    bound closer to the norm.
    """
    factor, log_size = space.start(probes, seed), 0.0
    for step in range(power + 1):
        factor = space.less(factor, v, space.inner(v, factor))
        space.keep_only(v, factor)
        y_cross, z_gram = space.sketch(factor, cross=step < power)
        if not np.isfinite(z_gram).all():
            raise ValueError("the matrix holds NaN or infinite values")
        size = float(z_gram.diagonal().max())
        if size <= 0:
            return float(space.noise)
        if step < power:
            factor = space.times(y_cross, np.eye(probes) / size)
            log_size += math.log(size)
    log_size += 0.5 * math.log(size) + 0.5 * math.log(2 / math.pi) - math.log(failure) / probes
    return max(math.exp(log_size / (2 * power + 1)), float(space.noise))


def kth_in(space, k: int, stop: Stop) -> Measure:
    """The k-th singular value of Yc; 0 beyond its rank."""
    factor, found = space.start(min(k + stop.oversample, space.n_cols), stop.seed), 0.0
    for _ in range(stop.norm_iter):
        factor, _ = space.svd(factor)
        y_cross, z_gram = space.sketch(factor)
        basis = whitener(z_gram)
        if not basis.shape[1]:
            return Measure(0.0)
        factor, sigma = space.svd(space.times(y_cross, basis))
        space.keep_only(factor)
        new = settled(float(sigma[k - 1]), stop.decimals) if len(sigma) >= k else 0.0
        if same(new, found, stop.rtol):
            return Measure(new)
        found = new
    return unsettled(found, f"singular value {k}", stop.norm_iter)


def loaded(space, components: DataFrame, k: int, orthonormalize: bool):
    v = space.load(components, k)
    return space.svd(v)[0] if orthonormalize else v


def relative(norm: float, next_sigma: float) -> float:
    if not next_sigma > 0:
        raise ValueError("the next singular value must be positive: the error is relative to it")
    return (norm - next_sigma) / next_sigma


def checked_order(k: int, n_cols: int) -> None:
    if k < 1 or k > n_cols:
        raise ValueError(f"k={k} must lie between 1 and the number of columns, {n_cols}")


def residual_spectral_norm(
    matrix: DataFrame,
    components: DataFrame,
    k: int,
    oversample: int = 10,
    norm_iter: int = 10,
    orthonormalize: bool = True,
    decimals: int = 4,
    rtol: float | None = None,
    n_rows: int | None = None,
    n_cols: int | None = None,
    seed: int = 0,
    **where,
) -> float:
    """Spectral norm of what components (col_id, comp, value) leave of the centred matrix.

    ``where`` takes limit, cache and partitions, as in ``sketch_pca``.
    """
    n_rows, n_cols = declared(matrix, n_rows, n_cols)
    checked_order(k, n_cols)
    stop = Stop(oversample, norm_iter, seed, decimals, rtol)
    with opened(matrix, max(k, 1 + oversample), n_rows, n_cols, **where) as space:
        return residual_norm_in(space, loaded(space, components, k, orthonormalize), stop)


def residual_norm_bound(
    matrix: DataFrame,
    components: DataFrame,
    k: int,
    failure: float = 1e-3,
    probes: int = 10,
    power: int = 2,
    orthonormalize: bool = True,
    n_rows: int | None = None,
    n_cols: int | None = None,
    seed: int = 0,
    **where,
) -> float:
    """A bound that the norm of ``residual_spectral_norm`` exceeds with a chance of ``failure`` at most.

    ``residual_spectral_norm`` comes from below and may stop short; this comes from above. The chance is over seeds
    and holds for any matrix, if the seed was not used to find the components. It takes ``power`` + 1 scans;
    each one narrows the distance to the norm: at 0 it can be several times as large, at 2 a third more or so.
    ``relative_spectral_bound`` sets it in relation to the next singular value.
    """
    if not 0 < failure < 1 or probes < 1 or power < 0:
        raise ValueError("failure must lie between 0 and 1, probes be 1 or more, power 0 or more")
    n_rows, n_cols = declared(matrix, n_rows, n_cols)
    checked_order(k, n_cols)
    with opened(matrix, max(k, probes), n_rows, n_cols, **where) as space:
        # A seed apart from those of fits, which begin at 0.
        return norm_bound_in(space, loaded(space, components, k, orthonormalize), failure, probes, power, seed + BOUND_SEED)


def relative_spectral_bound(matrix: DataFrame, components: DataFrame, k: int, next_sigma: float, **options) -> float:
    """A bound of the error relative to the given k+1st singular value; options as in ``residual_norm_bound``."""
    relative(0.0, next_sigma)
    return relative(residual_norm_bound(matrix, components, k, **options), next_sigma)


def kth_singular_value(
    matrix: DataFrame,
    k: int,
    oversample: int = 10,
    norm_iter: int = 10,
    decimals: int = 4,
    rtol: float | None = None,
    n_rows: int | None = None,
    n_cols: int | None = None,
    seed: int = 0,
    **where,
) -> float:
    """The k-th singular value of the centred matrix; 0 beyond its rank."""
    n_rows, n_cols = declared(matrix, n_rows, n_cols)
    checked_order(k, n_cols)
    with opened(matrix, k + oversample, n_rows, n_cols, **where) as space:
        return kth_in(space, k, Stop(oversample, norm_iter, seed, decimals, rtol))


def relative_spectral_error(
    matrix: DataFrame,
    components: DataFrame,
    k: int,
    next_sigma: float | None = None,
    oversample: int = 10,
    norm_iter: int = 10,
    orthonormalize: bool = True,
    decimals: int = 4,
    rtol: float | None = None,
    n_rows: int | None = None,
    n_cols: int | None = None,
    seed: int = 0,
    **where,
) -> float:
    """(residual norm - s) / s with s the k+1st singular value, found here unless it is given."""
    n_rows, n_cols = declared(matrix, n_rows, n_cols)
    checked_order(k + (next_sigma is None), n_cols)
    stop = Stop(oversample, norm_iter, seed, decimals, rtol)
    with opened(matrix, k + 1 + oversample, n_rows, n_cols, **where) as space:
        if next_sigma is None:
            next_sigma = kth_in(space, k + 1, stop)
        relative(0.0, next_sigma)
        norm = residual_norm_in(space, loaded(space, components, k, orthonormalize), stop)
    return relative(norm, next_sigma)


def evaluate_components(
    matrix: DataFrame, components: DataFrame, k: int, next_sigma: float, **options
) -> tuple[float, float]:
    """(residual norm, relative error) of stored components, taken as they are, at 3 decimals."""
    relative(0.0, next_sigma)
    options = {"orthonormalize": False, "decimals": 3, **options}
    norm = residual_spectral_norm(matrix, components, k, **options)
    return norm, relative(norm, next_sigma)
