"""Small matrices inside tasks: packing, solving, decomposing. Each works on one key's sums."""

from __future__ import annotations

import numpy as np


def packed_size(p: int) -> int:
    return p * (p + 1) // 2


def pack(g: np.ndarray) -> np.ndarray:
    return g[..., *np.triu_indices(g.shape[-1])]


def unpack(v) -> np.ndarray:
    """Symmetric matrix (or stack of them) from packed upper triangles."""
    v = np.asarray(v, dtype=float)
    p = int((np.sqrt(8 * v.shape[-1] + 1) - 1) / 2)
    out = np.zeros((*v.shape[:-1], p, p))
    i, j = np.triu_indices(p)
    out[..., i, j] = v
    out[..., j, i] = v
    return out


def centred(g: np.ndarray):
    """(n, mean, centred cross-products) of an augmented cross-product matrix, intercept first."""
    n = g[..., 0, 0]
    mean = g[..., 0, 1:] / n[..., None]
    s = g[..., 1:, 1:] - n[..., None, None] * mean[..., :, None] * mean[..., None, :]
    return n, mean, s


def about(n: np.ndarray, mean: np.ndarray, g: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Augmented cross-products around ``point`` of matrices ``g`` that lie around their own ``mean``."""
    d = mean - point
    out = g.copy()
    out[..., 0, 1:] = out[..., 1:, 0] = n[..., None] * d
    out[..., 1:, 1:] += n[..., None, None] * d[..., :, None] * d[..., None, :]
    return out


def condition_on(g: np.ndarray, given, rest) -> np.ndarray:
    """Cross-products of the ``rest`` columns after regressing out the ``given`` columns."""
    a = g[np.ix_(given, given)]
    b = g[np.ix_(given, rest)]
    return g[np.ix_(rest, rest)] - b.T @ np.linalg.pinv(a) @ b


def symmetric_eigen(s: np.ndarray):
    """Eigenvalues descending with canonical signs: the largest loading of a vector is positive."""
    w, v = np.linalg.eigh(s)
    w, v = w[..., ::-1], v[..., ::-1]
    top = np.take_along_axis(v, np.abs(v).argmax(axis=-2, keepdims=True), axis=-2)
    return w, v * np.where(top < 0, -1.0, 1.0)
