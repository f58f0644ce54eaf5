"""Exact leading components of wide matrices by block Lanczos steps with thick restarts, one scan per step."""

from __future__ import annotations

import time
import warnings

import numpy as np

from .pca import RANKS, Fit, some_basis

# Blocks that a basis holds before it is cut back, and blocks that stay then.
FULL, KEPT = 6, 2

# Directions of a new block below this share of the largest image are rounding.
NOTHING_NEW = 1e-13


def new_directions(block: np.ndarray, basis: np.ndarray, floor: float) -> np.ndarray:
    """Orthonormal columns for what of ``block`` lies outside the basis; none if that is rounding."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, size, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, size > floor]
    u -= basis @ (basis.T @ u)
    return np.linalg.qr(u)[0]


def lanczos_in(space, k: int, seed: int, rtol: float, max_scans: int) -> Fit:
    """The k leading components of an opened space, each with a residual below ``rtol`` times its eigenvalue.

    A step multiplies one block by Yc'Yc, in one scan, and adds it to an orthonormal basis; the components are
    the best ones within the basis (Rayleigh-Ritz). A full basis is cut back to its best directions and goes
    on from the same next block, so nothing is lost of what they know. Basis and images are arrays on the
    driver. A block is wider than k, so values that repeat are found as often as they occur.
    """
    n_cols, width = space.n_cols, min(k + 5, space.n_cols)
    basis, images = np.zeros((n_cols, 0)), np.zeros((n_cols, 0))
    block = np.linalg.qr(space.start(width, seed))[0]
    fit = Fit(None, np.zeros(0), 0, n_cols, 0, converged=False)
    while True:
        began = time.perf_counter()
        image = space.sketch(block, gram=False)[0]
        if not np.isfinite(image).all():
            raise ValueError("the matrix holds NaN or infinite values")
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        fit.passes += 1
        inner = basis.T @ images
        power, mix = np.linalg.eigh((inner + inner.T) / 2)
        power, mix = power[::-1], mix[:, ::-1]
        some = power[:k] > max(power[0], 0.0) * RANKS["fused"] ** 2
        rest = images @ mix[:, :k] - basis @ (mix[:, :k] * power[:k])
        far = np.linalg.norm(rest, axis=0) > rtol * np.abs(power[:k])
        fit.pass_seconds.append(time.perf_counter() - began)
        block = new_directions(image, basis, NOTHING_NEW * max(power[0], 0.0))
        fit.converged = not (far & some).any() and len(power) >= k or not block.shape[1]
        if fit.converged or fit.passes >= max_scans:
            break
        if basis.shape[1] + block.shape[1] > FULL * width:
            basis, images = basis @ mix[:, : KEPT * width], images @ mix[:, : KEPT * width]
    if not fit.converged:
        warnings.warn(f"{k} components did not settle in {max_scans} scans; allow more of them with max_scans")
    sigma = np.sqrt(np.maximum(power[:k], 0.0))
    rank = int((sigma > max(space.noise, RANKS["fused"] * sigma.max(initial=0.0))).sum())
    if rank < k:
        warnings.warn(f"the matrix has rank {rank}, so there are no {k} components")
    some_basis(np.eye(rank))
    components = basis @ mix[:, :rank]
    fit.components, fit.sigma, fit.n_rows = space.table(components * space.signs(components)), sigma[:rank], space.n_rows
    return fit
