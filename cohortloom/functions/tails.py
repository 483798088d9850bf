"""Tail probabilities. Spark has no gamma, beta or error function, so these small numeric
helpers run in Arrow batches over rows that are already aggregated."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


# Functions, not module-level vectorised objects: those keep a compiled part after their first call
# on the driver that cannot be sent to a worker.
def _lgamma(v):
    return np.vectorize(math.lgamma, otypes=[float])(v)


def _erfc(v):
    return np.vectorize(math.erfc, otypes=[float])(v)


def _beta_fraction(a, b, x, eps=1e-15, steps=20000):
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, steps):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < eps):
            break
    return h


def beta_cdf(x, a, b):
    """Regularised incomplete beta function, elementwise."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, a, b)))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)] = 0.0
    out[ok & (x >= 1)] = 1.0
    todo = ok & (x > 0) & (x < 1)
    if todo.any():
        xs, p, q = x[todo], a[todo], b[todo]
        swap = xs > (p + 1) / (p + q + 2)
        u = np.where(swap, 1 - xs, xs)
        p2, q2 = np.where(swap, q, p), np.where(swap, p, q)
        front = np.exp(
            _lgamma(p2 + q2) - _lgamma(p2) - _lgamma(q2) + p2 * np.log(u) + q2 * np.log1p(-u)
        ) / p2
        v = front * _beta_fraction(p2, q2, u)
        out[todo] = np.where(swap, 1 - v, v)
    return out


def t_sf(t, df):
    """P(T > t)."""
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    half = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return np.where(t >= 0, half, 1 - half)


def f_sf(f, d1, d2):
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    return beta_cdf(d2 / (d2 + d1 * np.maximum(f, 0)), d2 / 2, d1 / 2)


def normal_sf(z):
    return 0.5 * _erfc(np.asarray(z, dtype=float) / math.sqrt(2))


def chi2_sf(x, k):
    """Upper incomplete gamma ratio: series below, continued fraction above the mean."""
    x, k = np.broadcast_arrays(np.asarray(x, dtype=float), np.asarray(k, dtype=float))
    out = np.full(x.shape, np.nan)
    for i in np.ndindex(x.shape):
        s, z = k[i] / 2, x[i] / 2
        if not (np.isfinite(s) and np.isfinite(z)) or s <= 0:
            continue
        if z <= 0:
            out[i] = 1.0
            continue
        front = math.exp(-z + s * math.log(z) - math.lgamma(s))
        if z < s + 1:
            term = total = 1 / s
            n = s
            while abs(term) > abs(total) * 1e-16:
                n += 1
                term *= z / n
                total += term
            out[i] = 1 - front * total
        else:
            b = z + 1 - s
            c, d = 1e300, 1 / b
            h = d
            for j in range(1, 100000):
                an = -j * (j - s)
                b += 2
                d = 1 / (an * d + b)
                c = b + an / c
                h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            out[i] = front * h
    return out


def binomial_two_sided(k, n):
    """Two-sided binomial p at 1/2; the distribution is symmetric, so twice the smaller tail."""
    k, n = (np.asarray(v, dtype=float) for v in (k, n))
    low = np.minimum(k, n - k)
    tail = np.where(low >= n, 1.0, beta_cdf(0.5, n - low, low + 1))
    return np.where(n > 0, np.minimum(1.0, 2 * tail), np.nan)


def binomial_sf(k, n):
    """P(X >= k) at 1/2."""
    k, n = (np.asarray(v, dtype=float) for v in (k, n))
    return np.where(n > 0, np.where(k <= 0, 1.0, beta_cdf(0.5, np.maximum(k, 1e-9), n - k + 1)), np.nan)


def fisher_two_sided(a, b, c, d):
    """Two-sided exact p of a 2x2 table: total probability of tables not likelier than this one."""
    out = []
    for w, x, y, z in zip(*(np.asarray(v, dtype=float) for v in (a, b, c, d)), strict=True):
        r1, r2, c1 = w + x, y + z, w + y
        n = r1 + r2
        norm = _lgamma(r1 + 1) + _lgamma(r2 + 1) - (_lgamma(n + 1) - _lgamma(c1 + 1) - _lgamma(n - c1 + 1))

        def logp(k):
            return norm - _lgamma(k + 1) - _lgamma(r1 - k + 1) - _lgamma(c1 - k + 1) - _lgamma(r2 - c1 + k + 1)

        lo, hi = int(max(0.0, c1 - r2)), int(min(r1, c1))
        mode = min(max(int((r1 + 1) * (c1 + 1) / (n + 2)), lo), hi)
        limit = float(logp(np.array([w]))[0]) + 1e-7

        def reach(end, step):
            """Number of tables from the mode to the first one on this side that is not likelier."""
            near, far = 0, abs(end - mode) + 1
            while near < far:
                mid = (near + far) // 2
                if float(logp(np.array([float(mode + step * mid)]))[0]) <= limit:
                    far = mid
                else:
                    near = mid + 1
            return near

        below, above = reach(lo, -1), reach(hi, 1)
        if not below or not above:
            out.append(1.0)
        else:
            out.append(min(1.0, _outward(logp, mode - below, lo, -1) + _outward(logp, mode + above, hi, 1)))
    return np.array(out)


def _outward(logp, start: int, end: int, step: int) -> float:
    """Sum of falling probabilities from ``start`` to ``end``, in blocks, until they no longer count."""
    total, size = 0.0, 4096
    while (end - start) * step >= 0:
        stop = start + step * min(size, abs(end - start) + 1)
        part = float(np.exp(logp(np.arange(start, stop, step, dtype=float))).sum())
        total += part
        if part <= total * 1e-17:
            break
        start, size = stop, min(2 * size, 1 << 20)
    return total


def wilcoxon_p(wplus, n, ties, tie_sum, alternative="two-sided"):
    """Signed-rank p: exact for n <= 50 without ties, otherwise the normal approximation."""
    out = []
    for w, m, has_ties, ts in zip(wplus, n, ties, tie_sum, strict=True):
        m = int(m)
        if m < 1:
            out.append(np.nan)
            continue
        if m <= 50 and not has_ties:
            counts = np.zeros(m * (m + 1) // 2 + 1)
            counts[0] = 1
            for r in range(1, m + 1):
                shifted = np.zeros_like(counts)
                shifted[r:] = counts[: counts.size - r]
                counts = counts + shifted
            probs = counts / counts.sum()
            i = int(round(w))
            low, high = probs[: i + 1].sum(), probs[i:].sum()
        else:
            mean = m * (m + 1) / 4
            sd = math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - ts / 48)
            z = (w - mean) / sd if sd > 0 else float("nan")
            high = 0.5 * math.erfc(z / math.sqrt(2))
            low = 0.5 * math.erfc(-z / math.sqrt(2))
        out.append({"greater": high, "less": low}.get(alternative, min(1.0, 2 * min(low, high))))
    return np.array(out, dtype=float)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(128)


def studentized_range_sf(q, k, df):
    """Tail of the studentised range by Gauss-Legendre quadrature over the scale and the position."""
    out = []
    phi = lambda z: np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = lambda z: 0.5 * _erfc(-z / math.sqrt(2))
    zs = _NODES * 8
    for qq, kk, v in zip(q, k, df, strict=True):
        if not np.isfinite(qq) or v < 1:
            out.append(np.nan)
            continue
        spread = 8 / math.sqrt(2 * v)
        lo, hi = max(1e-8, 1 - spread), 1 + spread * (1 if v > 4 else 3)
        s = lo + (hi - lo) * (_NODES + 1) / 2
        ws = _WEIGHTS * (hi - lo) / 2
        logd = (
            (v / 2) * math.log(v) - math.lgamma(v / 2) - (v / 2 - 1) * math.log(2)
            + (v - 1) * np.log(s) - v * s * s / 2
        )
        grid = zs[None, :]
        inner = kk * phi(grid) * (cdf(grid) - cdf(grid - qq * s[:, None])) ** (kk - 1)
        prob = (inner * _WEIGHTS[None, :] * 8).sum(axis=1)
        mass = (np.exp(logd) * ws).sum()
        out.append(float(np.clip(1 - (np.exp(logd) * prob * ws).sum() / mass, 0, 1)))
    return np.array(out, dtype=float)


@F.pandas_udf(DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """One-sided upper tail of Student's t."""
    return pd.Series(t_sf(t.astype(float), df.astype(float)))


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_sf(f.astype(float), d1.astype(float), d2.astype(float)))


@F.pandas_udf(DoubleType())
def z_tail(z: pd.Series) -> pd.Series:
    return pd.Series(normal_sf(z.astype(float)))


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(x.astype(float), k.astype(float)))


@F.pandas_udf(DoubleType())
def beta_tail(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """P(B > x) for a beta variable on [0, 1]."""
    x, a, b = (v.astype(float) for v in (x, a, b))
    return pd.Series(beta_cdf(1 - x, b, a))


@F.pandas_udf(DoubleType())
def binomial_p(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(binomial_two_sided(k.astype(float), n.astype(float)))


@F.pandas_udf(DoubleType())
def binomial_upper(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(binomial_sf(k.astype(float), n.astype(float)))


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(fisher_two_sided(a, b, c, d))


@F.pandas_udf(DoubleType())
def tukey_tail(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(studentized_range_sf(q.astype(float), k.astype(float), df.astype(float)))


def wilcoxon_tail(alternative: str):
    @F.pandas_udf(DoubleType())
    def p(w: pd.Series, n: pd.Series, ties: pd.Series, tie_sum: pd.Series) -> pd.Series:
        return pd.Series(wilcoxon_p(w, n, ties, tie_sum, alternative))

    return p


def two_sided_t(t, df):
    """Two-sided p of a t statistic; NULL where it is NULL."""
    return F.when(t.isNotNull(), 2 * t_tail(F.abs(t), df.cast("double")))
