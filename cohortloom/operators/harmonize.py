"""Removal of site effects by empirical-Bayes location and scale adjustment (Johnson et al. 2007).

All estimates follow from cross-products per (feature, parcel, site), so the rows are read once for
the sums and once to be adjusted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from cohortloom.functions.small import about, unpack
from cohortloom.operators.gram import key_fields, moments


def _eb(gamma_hat, delta_hat, n, ss, sx, tol=1e-4, rounds=1000):
    """Posterior site means and variances; one array entry per parcel, priors pooled over them."""
    g_bar, t2 = gamma_hat.mean(), gamma_hat.var(ddof=1)
    m, s2 = delta_hat.mean(), delta_hat.var(ddof=1)
    if not (t2 > 0 and s2 > 0):
        return gamma_hat, delta_hat
    a, b = (2 * s2 + m * m) / s2, (m * s2 + m**3) / s2
    g, d = gamma_hat.copy(), delta_hat.copy()
    for _ in range(rounds):
        g_new = (t2 * n * gamma_hat + d * g_bar) / (t2 * n + d)
        spread = ss - 2 * g_new * sx + n * g_new * g_new
        d_new = (0.5 * spread + b) / (n / 2 + a - 1)
        change = max(np.abs((g_new - g) / np.where(g == 0, 1, g)).max(), np.abs((d_new - d) / d).max())
        g, d = g_new, d_new
        if change < tol:
            break
    return g, d


def site_coefficients(df: DataFrame, feature: str, parcel: str, batch: str, value: str, covariates) -> DataFrame:
    """Per (feature, parcel, batch): ``coef`` = (slope, intercept, one slope per covariate), such
    that the harmonised value is ``slope * y + intercept + sum(coef * covariate)``."""
    q = len(covariates)
    g = moments(df, [feature, parcel, batch], [*covariates, value])
    schema = StructType([*key_fields(g, [feature, parcel, batch]), StructField("coef", ArrayType(DoubleType()))])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        # One feature: parcels x batches of cross-products, however many subjects there are.
        pdf = pdf.sort_values([parcel, batch]).reset_index(drop=True)
        m, mean = unpack(np.vstack(pdf["_gram"].to_numpy())), np.vstack(pdf["_mean"].to_numpy())
        batches = pdf[batch].unique()
        code = pdf[batch].map({b: i for i, b in enumerate(batches)}).to_numpy()
        parcels, inv = np.unique(pdf[parcel].to_numpy(), return_inverse=True)
        k, p = len(batches), len(parcels)
        # Sums around one point of the parcel, which is put back into the intercept.
        size = m[:, 0, 0]
        point = np.column_stack([np.bincount(inv, size * c) for c in mean.T]) / np.bincount(inv, size)[:, None]
        m = about(size, mean, m, point[inv])
        nb, ny, yy = (np.zeros((p, k)) for _ in range(3))
        xb, xyb, xxb = np.zeros((p, k, q)), np.zeros((p, k, q)), np.zeros((p, k, q, q))
        nb[inv, code], ny[inv, code], yy[inv, code] = m[:, 0, 0], m[:, 0, -1], m[:, -1, -1]
        xb[inv, code], xyb[inv, code], xxb[inv, code] = m[:, 0, 1:-1], m[:, 1:-1, -1], m[:, 1:-1, 1:-1]
        # Design: one indicator per batch, then the covariates.
        a = np.zeros((p, k + q, k + q))
        a[:, np.arange(k), np.arange(k)] = nb
        a[:, :k, k:] = xb
        a[:, k:, :k] = xb.transpose(0, 2, 1)
        a[:, k:, k:] = xxb.sum(axis=1)
        r = np.concatenate([ny, xyb.sum(axis=1)], axis=1)
        beta = np.einsum("pij,pj->pi", np.linalg.pinv(a, hermitian=True), r)
        n = nb.sum(axis=1)
        grand = (nb / n[:, None] * beta[:, :k]).sum(axis=1)
        var = (yy.sum(axis=1) - np.einsum("pi,pi->p", beta, r)) / n
        sd = np.sqrt(np.maximum(var, 1e-300))
        cov = beta[:, k:]
        slope, shift = np.ones((p, k)), np.zeros((p, k))
        for b in range(k):
            # Sums of the standardised residual u = (y - grand - x cov) / sd inside the batch.
            xc = np.einsum("pq,pq->p", xb[:, b], cov)
            nn = np.maximum(nb[:, b], 1)
            su = (ny[:, b] - nb[:, b] * grand - xc) / sd
            quad = (
                yy[:, b] + nb[:, b] * grand**2 + np.einsum("pq,pqr,pr->p", cov, xxb[:, b], cov)
                - 2 * grand * ny[:, b] - 2 * np.einsum("pq,pq->p", xyb[:, b], cov) + 2 * grand * xc
            ) / sd**2
            gamma = su / nn
            delta = np.maximum((quad - nn * gamma**2) / np.maximum(nn - 1, 1), 1e-12)
            gs, ds = _eb(gamma, delta, nb[:, b], quad, su) if p > 1 else (gamma, delta)
            slope[:, b] = 1 / np.sqrt(ds)
            shift[:, b] = gs / np.sqrt(ds)
        s, h = slope[inv, code], shift[inv, code]
        base = (grand + point[:, -1] - (cov * point[:, :-1]).sum(axis=1))[inv] * (1 - s) - h * sd[inv]
        out = pdf[[feature, parcel, batch]].copy()
        out["coef"] = list(np.column_stack([s, base, cov[inv] * (1 - s)[:, None]]))
        return out

    return g.groupBy(feature).applyInPandas(fit, schema)


def combat(df: DataFrame, feature: str, parcel: str, batch: str, value: str, covariates, out: str = "harmonised") -> DataFrame:
    c = site_coefficients(df, feature, parcel, batch, value, covariates)
    y = F.element_at("coef", 1) * F.col(value) + F.element_at("coef", 2)
    for i, x in enumerate(covariates):
        y = y + F.element_at("coef", i + 3) * F.col(x)
    return df.join(c, [feature, parcel, batch]).withColumn(out, y).drop("coef")
