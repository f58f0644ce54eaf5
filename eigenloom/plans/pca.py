"""Principal components by randomized sketching: the fit in its three forms, and its stop rules."""

from __future__ import annotations

import time
import warnings
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame

from ..functions.seeds import SIGNS
from .journal import Journal
from .residual import Stop, kth_in, relative, residual_norm_in, whitener
from .spaces import RANK_TOLERANCE, declared, opened


@dataclass
class Fit:
    """The outcome of a fit: components as (col_id, comp, value) and a handful of figures."""

    components: DataFrame | None
    sigma: np.ndarray
    n_rows: int
    n_cols: int
    passes: int
    errors: list[float] = field(default_factory=list)
    preprocess_seconds: float = 0.0
    pass_seconds: list[float] = field(default_factory=list)
    # Whether every measured number settled and, where an error was asked for, it came within the tolerance.
    converged: bool = True

    @property
    def avg_pass_seconds(self) -> float:
        return sum(self.pass_seconds) / max(self.passes, 1)

    @property
    def total_seconds(self) -> float:
        return self.preprocess_seconds + sum(self.pass_seconds)

    def sigma_table(self) -> DataFrame:
        """(comp, sigma)"""
        spark = self.components.sparkSession
        pairs = [(j, float(x)) for j, x in enumerate(self.sigma)]
        return spark.createDataFrame(pairs, "comp int, sigma double")


def r_whitener(r: np.ndarray) -> np.ndarray:
    """T with (Z T)'(Z T) = I, from the R factor of Z."""
    if not np.isfinite(r).all():
        raise ValueError("the matrix holds NaN or infinite values")
    _, sigma, w = np.linalg.svd(r)
    sigma = np.pad(sigma, (0, len(w) - len(sigma)))
    keep = sigma > RANK_TOLERANCE * max(sigma[0], 0.0)
    return w[keep].T / sigma[keep]


def some_basis(basis: np.ndarray) -> np.ndarray:
    if not basis.shape[1]:
        raise ValueError("the centred matrix is zero: it has no components")
    return basis


def fused_pass(space, factor):
    """Both products in one scan; the cross product is whitened afterwards."""
    y_cross, z_gram = space.sketch(factor)
    return space.times(y_cross, some_basis(whitener(z_gram)))


def two_pass(space, factor):
    """A Gram-only scan to whiten the factor, then a scan for the cross product."""
    _, z_gram = space.sketch(factor, cross=False)
    return space.sketch(space.times(factor, some_basis(whitener(z_gram))), gram=False)[0]


def tsqr_pass(space, factor):
    """A tree QR scan to whiten the factor without squaring its condition, then the cross product."""
    r = space.stack_r(factor)
    return space.sketch(space.times(factor, some_basis(r_whitener(r))), gram=False)[0]


PASSES = {"fused": fused_pass, "two_pass": two_pass, "tsqr": tsqr_pass}

# Draws of a sign for each column, 0 for normal numbers throughout.
STARTS = {"gaussian": 0, "sparse_sign": SIGNS, "count_sketch": 1}

# Singular values below this share of the first are lost: to a squared condition number, or to rounding.
RANKS = {"fused": RANK_TOLERANCE**0.5, "two_pass": RANK_TOLERANCE**0.5, "tsqr": RANK_TOLERANCE}


def checked_k(k: int, n_cols: int) -> int:
    """k components of n_cols columns; asking for all of them gives one fewer."""
    if k < 1 or k > n_cols:
        raise ValueError(f"k={k} must lie between 1 and the number of columns, {n_cols}")
    return k - 1 if k == n_cols and k > 1 else k


def leading_of(space, factor, sigma: np.ndarray, k: int, method: str):
    """How many of the first k directions are more than rounding, and those."""
    floor = max(space.noise, RANKS[method] * sigma.max(initial=0.0))
    rank = min(k, int((sigma > floor).sum()))
    some_basis(np.eye(rank))
    return rank, space.times(factor, np.eye(len(sigma))[:, :rank])


def fit_in(
    space,
    k: int,
    oversample: int,
    max_iter: int,
    tolerance: float,
    next_sigma: float | None,
    method: str,
    stop: Stop,
    start: str = "gaussian",
    journal: Journal | None = None,
) -> Fit:
    """Passes over an opened space until ``max_iter``, or until the error is small enough."""
    began = time.perf_counter()
    k = checked_k(k, space.n_cols)
    width = min(k + oversample, space.n_cols)
    fit = Fit(None, np.zeros(0), 0, space.n_cols, 0)
    error, rank, state = tolerance + 1, 0, journal.last() if journal else None
    if state:
        # The factor of the last finished pass, with the figures it had.
        sigma = np.array(state["sigma"])
        factor = space.load(journal.factor(state), len(sigma))
        space.take_means(journal.means(state), state["n_rows"])
        fit.passes, fit.errors = state["pass"], list(state["errors"])
        error = fit.errors[-1] if fit.errors else error
        rank, leading = leading_of(space, factor, sigma, k, method)
    elif start == "gaussian":
        # Every pass starts from orthonormal columns: the first from these, the others from what came before.
        factor, _ = space.svd(space.start(width, stop.seed))
    else:
        # Columns of signs are close to orthogonal as they are, and need not be written out.
        factor = space.start(width, stop.seed, STARTS[start])
    fit.preprocess_seconds = time.perf_counter() - began
    while fit.passes < max_iter and error > tolerance:
        began = time.perf_counter()
        factor, sigma = space.svd(PASSES[method](space, factor))
        space.keep_only(factor)
        rank, leading = leading_of(space, factor, sigma, k, method)
        fit.passes += 1
        fit.pass_seconds.append(time.perf_counter() - began)
        if next_sigma is not None:
            norm = residual_norm_in(space, leading, replace(stop, seed=stop.seed + fit.passes))
            error = relative(norm, next_sigma)
            fit.errors.append(error)
            fit.converged = norm.converged and getattr(next_sigma, "converged", True) and error <= tolerance
        if journal:
            journal.commit(fit.passes, space.table(factor), space.kept_means(), sigma, fit.errors, space.n_rows)
    if next_sigma is not None and error > tolerance:
        warnings.warn(f"the error is {error:.4g} after {fit.passes} passes; the tolerance is {tolerance}")
    if rank < k:
        warnings.warn(f"the centred matrix has rank {rank}; asked for {k} components")
    fit.components = space.table(space.times(leading, np.diag(space.signs(leading))))
    fit.sigma, fit.n_rows = sigma[:rank], space.n_rows
    return fit


def sketch_pca(
    matrix: DataFrame,
    k: int,
    oversample: int = 10,
    max_iter: int = 50,
    tolerance: float = 0.05,
    next_sigma: float | None = None,
    norm_iter: int = 10,
    norm_oversample: int = 10,
    method: str = "fused",
    n_rows: int | None = None,
    n_cols: int | None = None,
    seed: int = 0,
    start: str = "gaussian",
    journal: str | None = None,
    **where,
) -> Fit:
    """The k leading principal components of the column-centred matrix.

    Runs ``max_iter`` passes. With ``next_sigma`` (the k+1st singular value, see
    ``kth_singular_value``) the relative spectral error is measured after every pass and the loop
    ends once it is at or below ``tolerance``.

    ``start`` is the matrix that the first pass multiplies by: ``gaussian``; or ``sparse_sign`` or
    ``count_sketch``, which tasks compute from the column ids, so that beyond the broadcast limit no factor
    is written or exchanged for that pass. They may need one pass more for the same error.

    ``journal`` names a folder in which every finished pass is kept. A call with the same folder and settings
    goes on after the last one, in another session too; with other settings it is an error. ``max_iter``
    counts the passes of all calls together.

    ``where`` takes ``limit``, the factor size up to which it is broadcast; ``cache=True`` to keep the
    rows in memory and on disk between passes (leave it off for a large stored table); and
    ``partitions`` to spread rows that come in too few scan tasks.
    """
    checked_options(method, max_iter, next_sigma, start)
    began = time.perf_counter()
    settings = {"k": k, "oversample": oversample, "method": method, "seed": seed, "start": start, "n_cols": n_cols, "n_rows": n_rows}
    kept = Journal(matrix.sparkSession, journal, settings) if journal else None
    n_rows, n_cols = declared(matrix, n_rows, n_cols)
    checked_k(k, n_cols)
    stop = Stop(norm_oversample, norm_iter, seed)
    width = max(k + oversample, 1 + norm_oversample)
    with opened(matrix, width, n_rows, n_cols, **where) as space:
        ready = time.perf_counter() - began
        fit = fit_in(space, k, oversample, max_iter, tolerance, next_sigma, method, stop, start, kept)
    fit.preprocess_seconds += ready
    return fit


def checked_options(method: str, max_iter: int, next_sigma: float | None, start: str = "gaussian") -> None:
    if start not in STARTS:
        raise ValueError(f"start must be one of {sorted(STARTS)}")
    if method not in PASSES:
        raise ValueError(f"method must be one of {sorted(PASSES)}")
    if max_iter < 1:
        raise ValueError("max_iter must be at least 1")
    if next_sigma is not None:
        relative(0.0, next_sigma)


def sketch_pca_two_pass(matrix: DataFrame, k: int, **options) -> Fit:
    return sketch_pca(matrix, k, method="two_pass", **options)


def sketch_pca_tsqr(matrix: DataFrame, k: int, **options) -> Fit:
    return sketch_pca(matrix, k, method="tsqr", **options)


def randomized_pca(matrix: DataFrame, k: int, p: int = 10, q: int = 0, **options) -> Fit:
    """The classic randomized preset: p extra directions and q power passes after the first."""
    return sketch_pca(matrix, k, oversample=p, max_iter=q + 1, **options)


def fit_until_tolerance(
    matrix: DataFrame,
    k: int,
    tolerance: float = 0.05,
    oversample: int = 10,
    max_iter: int = 50,
    norm_iter: int = 10,
    norm_oversample: int = 10,
    method: str = "fused",
    n_rows: int | None = None,
    n_cols: int | None = None,
    seed: int = 0,
    **where,
) -> Fit:
    """Find the k+1st singular value, then refine until the relative spectral error is small.

    Both steps share one space, hence one scan for the means and one stored or cached matrix.
    """
    checked_options(method, max_iter, None)
    began = time.perf_counter()
    n_rows, n_cols = declared(matrix, n_rows, n_cols)
    k = checked_k(k, n_cols)
    stop = Stop(norm_oversample, norm_iter, seed)
    width = max(k + 1 + oversample, 1 + norm_oversample)
    with opened(matrix, width, n_rows, n_cols, **where) as space:
        next_sigma = kth_in(space, k + 1, replace(stop, oversample=oversample))
        relative(0.0, next_sigma)
        ready = time.perf_counter() - began
        fit = fit_in(space, k, oversample, max_iter, tolerance, next_sigma, method, stop)
    fit.preprocess_seconds += ready
    return fit
