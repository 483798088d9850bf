"""Feature similarity and participation ratios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from cohortloom.functions.small import centred, pack, unpack
from cohortloom.operators.axis import collapse_delays
from cohortloom.operators.gram import check_width, gram_wide, key_fields, map_rows, moments_wide, sum_grams, triangle
from cohortloom.operators.harmonize import combat
from cohortloom.operators.hierarchy import add_ancestors, regress_frequency
from cohortloom.operators.stats import two_sample_t
from cohortloom.operators.temporal import zscore

METRICS = ("cov", "corr", "cosine", "euc")


def _similarity(g: np.ndarray, metric: str) -> np.ndarray:
    n, _, s = centred(g)
    raw = g[:, 1:, 1:]
    diag = np.arange(raw.shape[1])
    if metric == "cov":
        return s / np.maximum(n - 1, 1)[:, None, None]
    if metric == "corr":
        d = np.sqrt(np.maximum(s[:, diag, diag], 0))
        with np.errstate(all="ignore"):
            r = np.nan_to_num(s / (d[:, :, None] * d[:, None, :]))
        r[:, diag, diag] = 0
        return np.arctanh(np.clip(r, -1 + 1e-15, 1 - 1e-15))
    d = raw[:, diag, diag]
    if metric == "cosine":
        norm = np.sqrt(d)
        with np.errstate(all="ignore"):
            return np.nan_to_num(raw / (norm[:, :, None] * norm[:, None, :]))
    if metric == "euc":
        return np.sqrt(np.maximum(d[:, :, None] + d[:, None, :] - 2 * raw, 0))
    raise ValueError(f"metric is one of {METRICS}")


def _ratio(sim: np.ndarray, metric: str) -> np.ndarray:
    if metric in ("cov", "cosine"):
        # No negative eigenvalues, so trace and Frobenius norm give the ratio directly.
        num, den = np.trace(sim, axis1=1, axis2=2) ** 2, (sim * sim).sum(axis=(1, 2))
    else:
        w = np.maximum(np.linalg.eigvalsh(sim), 0)
        num, den = w.sum(axis=1) ** 2, (w * w).sum(axis=1)
    return np.divide(num, den, out=np.zeros_like(num), where=den > 0)


def similarity(df: DataFrame, keys, vec: str, width: int, metric: str) -> DataFrame:
    """Packed feature x feature similarity per key: ``(keys, n, sim)``."""
    check_width(width)
    # Covariances and correlations are products around the mean; the others need the raw ones.
    g = (moments_wide if metric in ("cov", "corr") else gram_wide)(df, keys, vec, width)
    schema = StructType([*key_fields(g, keys), StructField("n", LongType()), StructField("sim", ArrayType(DoubleType()))])

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        m = unpack(np.vstack(pdf["_gram"].to_numpy()))
        out = pdf[list(keys)].copy()
        out["n"] = m[:, 0, 0].astype("int64")
        out["sim"] = list(pack(_similarity(m, metric)))
        return out

    return map_rows(g, keys, step, schema)


def participation_ratio(df: DataFrame, keys, vec: str, width: int, metric: str, min_n: int = 10) -> DataFrame:
    """Participation ratio per key; 0 for keys with fewer than ``min_n`` rows."""
    return ratio_of(similarity(df, keys, vec, width, metric), keys, metric, min_n)


def ratio_of(sims: DataFrame, keys, metric: str, min_n: int = 0) -> DataFrame:
    has_n = "n" in sims.columns

    @F.pandas_udf(DoubleType())
    def pr(sim: pd.Series) -> pd.Series:
        return pd.Series(_ratio(unpack(np.vstack(sim.to_numpy())), metric))

    value = pr("sim")
    if has_n:
        return sims.select(*keys, "n", F.when(F.col("n") < min_n, 0.0).otherwise(value).alias("pr"))
    return sims.select(*keys, value.alias("pr"))


def group_similarity(sims: DataFrame, keys) -> DataFrame:
    """Cell-wise mean of packed similarity matrices over subjects."""
    keys = list(keys)
    # A one at the end of each matrix counts them, so that sums and number come from one pass.
    counted = sims.filter(F.size("sim") > 0).select(*keys, F.concat("sim", F.array(F.lit(1.0))).alias("sim"))
    total = sum_grams(counted, keys, "sim")
    return total.select(*keys, F.transform(F.slice("sim", F.lit(1), F.size("sim") - 1), lambda v: v / F.element_at("sim", -1)).alias("sim"))


def similarity_cells(sims: DataFrame, keys, width: int) -> DataFrame:
    """Long upper triangle ``(keys, f1, f2, s)``."""
    i, j = triangle("_p", width)
    return sims.select(*keys, F.posexplode("sim").alias("_p", "s")).select(*keys, i.alias("f1"), j.alias("f2"), "s")


def region_set_pr(sims: DataFrame, regions: DataFrame, subject: str, parcel: str, metric: str, groups: DataFrame, group: str, first, second):
    """Ratio of the subject's similarity averaged over a region set, and its two-sample t."""
    mean = group_similarity(sims.join(regions, parcel, "left_semi"), [subject])
    pr = ratio_of(mean, [subject], metric).join(groups, subject)
    return pr, two_sample_t(pr, [], group, first, second, "pr")


def prepare_weights(w: DataFrame, subject: str, parcel: str, feature: str, value: str, *, delay=None, pool="mean", harmonise=None, frequency=None, hierarchy=None, standardise=False, vertex: str | None = None) -> DataFrame:
    """Switchable chain: pool delays, harmonise sites, regress frequency, add ancestors, z-score.

    ``harmonise`` = (batch column, covariate columns), ``frequency`` = (table, column),
    ``hierarchy`` = (closure, vocabulary).
    """
    unit = vertex or parcel
    keep = [harmonise[0], *harmonise[1]] if harmonise else []
    carried = [subject, *([parcel] if vertex else []), unit, feature, *keep]
    if delay:
        w = collapse_delays(w, carried, delay, value, pool)
    if harmonise:
        w = combat(w, feature, unit, harmonise[0], value, harmonise[1], "_h").withColumn(value, F.col("_h")).drop("_h")
    keys = [subject, *([parcel] if vertex else []), unit]
    w = w.select(*keys, feature, value)
    if frequency:
        w = regress_frequency(w, frequency[0], keys, feature, value, frequency[1])
    if hierarchy:
        w = add_ancestors(w, hierarchy[0], hierarchy[1], keys, feature, value)
    if standardise:
        w = zscore(w, keys, value, 0, "_z").withColumn(value, F.coalesce("_z", F.lit(0.0))).drop("_z")
    return w
