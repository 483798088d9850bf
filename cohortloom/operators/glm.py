"""Mass-univariate linear models from grouped cross-products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from cohortloom.functions import tails
from cohortloom.functions.small import unpack
from cohortloom.operators.gram import moments
from cohortloom.operators.stats import bh
from cohortloom.operators.temporal import join_stats

_FIT = StructType(
    [
        StructField("n", LongType()),
        StructField("beta", DoubleType()),
        StructField("se", DoubleType()),
        StructField("t", DoubleType()),
        StructField("df", DoubleType()),
    ]
)


FLAT = 1e-13
"""Spread of a response, as a share of its mean, that counts as none."""


def contrast_of(which: int):
    """Batch solver for the slope of design column ``which`` (from 1) from moments; y is the last column."""

    @F.pandas_udf(_FIT)
    def solve(g: pd.Series, mean: pd.Series) -> pd.DataFrame:
        m = unpack(np.vstack(g.to_numpy()))
        n, x, xy, yy = m[:, 0, 0], m[:, 1:-1, 1:-1], m[:, 1:-1, -1], m[:, -1, -1]
        # Columns of unit length, so that terms of very different size do not decide the rank.
        size = np.sqrt(np.einsum("kii->ki", x))
        size = np.where(size > FLAT * np.abs(np.vstack(mean.to_numpy()))[:, :-1] * np.sqrt(n)[:, None], size, np.inf)
        unit = x / size[:, :, None] / size[:, None, :]
        inv = np.linalg.pinv(unit, hermitian=True) / size[:, :, None] / size[:, None, :]
        beta = np.einsum("kij,kj->ki", inv, xy)
        dof = n - 1 - np.linalg.matrix_rank(unit, hermitian=True)
        sse = yy - np.einsum("ki,ki->k", beta, xy)
        none = yy <= n * (FLAT * np.stack(mean.to_numpy())[:, -1]) ** 2
        flat = none | (sse <= 1e-12 * np.maximum(yy, 1e-300))
        with np.errstate(all="ignore"):
            se = np.sqrt(np.where(flat, np.nan, sse) / dof * inv[:, which - 1, which - 1])
            t = beta[:, which - 1] / se
        t = np.where(none, 0.0, t)
        return pd.DataFrame({"n": n.astype("int64"), "beta": beta[:, which - 1], "se": se, "t": t, "df": dof.astype(float)})

    return solve


def glm(df: DataFrame, keys, y: str, terms, tail: str = "two") -> DataFrame:
    """Fit ``y ~ 1 + terms`` per key; t and p of the first term.

    ``tail='one'`` gives the upper tail of |t|, ``'two'`` twice that. A response without variance
    gets t = 0 and p = 1 and ``tested = false``.
    """
    g = moments(df, keys, [*terms, y]).withColumn("_f", contrast_of(1)("_gram", "_mean"))
    out = g.select(*keys, "_f.*")
    p1 = tails.t_tail(F.abs("t"), F.col("df"))
    out = out.withColumn("p", p1 if tail == "one" else 2 * p1)
    tested = F.col("se").isNotNull() & ~F.isnan("se")
    return out.withColumn("tested", tested).withColumn("p", F.when(F.col("tested"), F.col("p")).otherwise(1.0)).withColumn(
        "t", F.when(F.col("tested"), F.col("t")).otherwise(0.0)
    )


def glm_fdr(df: DataFrame, key: str, y: str, terms, tail: str, alpha: float, family=(), small_family: bool = False) -> DataFrame:
    """Model per parcel, adjusted p over the tested parcels, signed significance."""
    g = glm(df, [*family, key], y, terms, tail)
    g = g.withColumn("_p", F.when(F.col("tested"), F.col("p")))
    g = bh(g, family, "_p", "p_adj", small_family).drop("_p").withColumn("p_adj", F.coalesce("p_adj", F.lit(1.0)))
    return g.withColumn("sig", F.when(F.col("p_adj") < alpha, F.signum("t")).otherwise(0.0).cast("int"))


def regress_out(df: DataFrame, keys, value: str, confounds, t: str | None = None, keep_mean: bool = True, small_keys: bool = False) -> DataFrame:
    """Residual of ``value`` on z-scored confounds per key, with its mean put back.

    With an intercept in the design the z-scoring of confounds changes nothing in the residual, so
    the slopes are solved on the products around the means. A confound that is all NULL counts as 0.
    ``t`` adds a linear trend. ``small_keys`` is for a few keys of many rows each: their slopes are sent to the rows,
    so no task reads all rows of a key.
    """
    keys = list(keys)
    d = df.fillna(0.0, list(confounds))
    cols = [*confounds, *([t] if t else [])]

    @F.pandas_udf(ArrayType(DoubleType()))
    def slopes(g: pd.Series) -> pd.Series:
        m = unpack(np.vstack(g.to_numpy()))
        return pd.Series(list(np.einsum("kij,kj->ki", np.linalg.pinv(m[:, 1:-1, 1:-1], hermitian=True), m[:, 1:-1, -1])))

    b = moments(d, keys, [*cols, value]).select(*keys, slopes("_gram").alias("_b"), F.col("_mean").alias("_m"))
    mean = F.element_at("_m", len(cols) + 1)
    fit = F.lit(0.0) if keep_mean else mean
    for i, c in enumerate(cols):
        fit = fit + F.element_at("_b", i + 1) * (F.col(c) - F.element_at("_m", i + 1))
    return join_stats(d, F.broadcast(b) if small_keys and keys else b, keys).withColumn("residual", F.col(value) - fit).drop("_b", "_m")
