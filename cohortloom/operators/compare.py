"""Comparison of models over repetitions, items and pairs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cohortloom.functions import tails
from cohortloom.functions.scalar import directional_p
from cohortloom.operators.stats import bh, sign_test, wilcoxon

# Compared pairs and the direction of each test.
PAIRS = (("combined", "a", "greater"), ("combined", "b", "greater"), ("a", "b", "two-sided"))


def model_differences(metrics: DataFrame, keys, pairs=PAIRS, model: str = "model", value: str = "r") -> DataFrame:
    """``(keys, pair, alternative, d)`` from one row per (keys, model)."""
    names = sorted({m for a, b, _ in pairs for m in (a, b)})
    wide = metrics.groupBy(*keys).agg(*[F.max(F.when(F.col(model) == m, F.col(value))).alias(f"_{m}") for m in names])
    rows = F.array(
        *[
            F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.lit(alt).alias("alternative"), (F.col(f"_{a}") - F.col(f"_{b}")).alias("d"))
            for a, b, alt in pairs
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("_p")).select(*keys, "_p.*").filter(F.col("d").isNotNull())


def _directed(p: str, stat: str) -> Column:
    return (
        F.when(F.col("alternative") == "greater", directional_p(p, stat, "greater"))
        .when(F.col("alternative") == "less", directional_p(p, stat, "less"))
        .otherwise(F.col(p))
    )


def split_half_cv(metrics: DataFrame, keys) -> DataFrame:
    """Both halves of a repetition side by side: ``(keys, rep, d_a, d_b)`` from rep = 2 * j + half."""
    j = F.floor(F.col("rep") / 2).cast("int")
    return metrics.groupBy(*keys, j.alias("rep")).agg(
        F.max(F.when(F.col("rep") % 2 == 0, F.col("d"))).alias("d_a"), F.max(F.when(F.col("rep") % 2 == 1, F.col("d"))).alias("d_b")
    )


_SCORE = StructType([StructField(c, DoubleType()) for c in ("rho", "sigma2", "z")])


@F.pandas_udf(_SCORE)
def _score(n: pd.Series, mean: pd.Series, anti: pd.Series, sym: pd.Series) -> pd.DataFrame:
    """Null likelihood over rho: the covariance has eigenvalues 1, 1 - 2 rho and 1 + 2 (J - 1) rho,
    so three sums decide it and the variance drops out in closed form."""
    j = n.to_numpy(dtype=float)[:, None]
    d, s, m = (v.to_numpy(dtype=float)[:, None] for v in (anti, sym, mean))
    along = 2 * j * m * m
    lo, hi = -1 / (2 * j - 1) + 1e-4, np.full_like(j, 0.5 - 1e-4)
    for _ in range(8):
        rho = lo + (hi - lo) * np.linspace(0, 1, 201)[None, :]
        q = d + s / (1 - 2 * rho) + along / (1 + 2 * (j - 1) * rho)
        cost = j * np.log(np.maximum(q, 1e-300)) + 0.5 * ((j - 1) * np.log(1 - 2 * rho) + np.log(1 + 2 * (j - 1) * rho))
        at = cost.argmin(axis=1)[:, None]
        pick = lambda i: np.take_along_axis(rho, np.clip(i, 0, 200), axis=1)
        best, lo, hi = pick(at), pick(at - 1), pick(at + 1)
    q = d + s / (1 - 2 * best) + along / (1 + 2 * (j - 1) * best)
    sigma2 = q / (2 * j)
    var = sigma2 * (1 / (2 * j) + (j - 1) / j * best)
    with np.errstate(all="ignore"):
        z = np.where((d > 0) & (var > 0), m / np.sqrt(var), np.nan)
    return pd.DataFrame({"rho": best[:, 0], "sigma2": sigma2[:, 0], "z": z[:, 0]})


def sharp_test(halves: DataFrame, keys) -> DataFrame:
    """Score test of a mean difference over split-half repetitions ``(keys, d_a, d_b)``."""
    a, b = F.col("d_a"), F.col("d_b")
    g = halves.groupBy(*keys).agg(
        F.count("*").alias("n_rep"),
        F.avg((a + b) / 2).alias("mean_diff"),
        (F.sum((a - b) * (a - b)) / 2).alias("_anti"),
        (F.var_pop(a + b) * F.count("*") / 2).alias("_sym"),
    )
    g = g.withColumn("_s", _score("n_rep", "mean_diff", "_anti", "_sym"))
    g = g.select(*keys, "n_rep", "mean_diff", "_s.*").withColumn("p", 2 * tails.z_tail(F.abs("z")))
    return g.withColumn("p", _directed("p", "z")) if "alternative" in keys else g


def corrected_t(diffs: DataFrame, keys, k: int, rho: float | None = None, value: str = "d") -> DataFrame:
    """Resampled t with the variance inflated for overlapping training sets."""
    rho = 1 / k if rho is None else rho
    g = diffs.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean_diff"), F.var_samp(value).alias("_v")
    )
    g = g.withColumn("t", F.when(F.col("_v") > 0, F.col("mean_diff") / F.sqrt((1 / F.col("n") + rho / (1 - rho)) * F.col("_v"))))
    g = g.withColumn("p", tails.two_sided_t(F.col("t"), F.col("n") - 1)).drop("_v")
    return g.withColumn("p", _directed("p", "t")) if "alternative" in keys else g


def compare_models(sharp: DataFrame, corrected: DataFrame, keys, small_family: bool = False) -> DataFrame:
    """Item x pair table with both tests, each adjusted over all rows."""
    s = sharp.select(*keys, "mean_diff", "z", F.col("p").alias("sharp_p"))
    c = corrected.select(*keys, "t", F.col("p").alias("corrected_p"))
    j = s.join(c, list(keys))
    return bh(bh(j, [], "sharp_p", "sharp_p_adj", small_family), [], "corrected_p", "corrected_p_adj", small_family)


def cross_item_trend(rows: DataFrame, pair: str, value: str, pairs=PAIRS) -> DataFrame:
    """Sign test and signed-rank test of the per-item differences, each adjusted over the pairs."""
    parts = []
    for alt in sorted({a for _, _, a in pairs}):
        names = [f"{x}_vs_{y}" for x, y, a in pairs if a == alt]
        part = rows.filter(F.col(pair).isin(*names))
        s = sign_test(part, [pair], value, alt).select(pair, "n_pos", "n_neg", F.col("p").alias("sign_p"))
        w = wilcoxon(part, [pair], value, alt).select(pair, "w_plus", F.col("p").alias("wilcoxon_p"))
        m = part.groupBy(pair).agg(F.count("*").alias("n_items"), F.avg(value).alias("mean_diff"))
        parts.append(m.join(s, pair).join(w, pair, "left").withColumn("alternative", F.lit(alt)))
    out = reduce(DataFrame.unionByName, parts)
    return bh(bh(out, [], "sign_p", "sign_p_adj", True), [], "wilcoxon_p", "wilcoxon_p_adj", True)


def per_rep_rate(diffs: DataFrame, rep: str, pair: str, value: str, alpha: float = 0.05, alternative: str = "two-sided") -> DataFrame:
    """Share of repetitions whose signed-rank test over items is significant."""
    w = wilcoxon(diffs, [pair, rep], value, alternative)
    reps = diffs.filter(F.col(value).isNotNull()).select(pair, rep).distinct()
    j = reps.join(w.select(pair, rep, "p"), [pair, rep], "left")
    return j.groupBy(pair).agg(F.count("*").alias("n_rep"), F.avg(F.coalesce(F.col("p") < alpha, F.lit(False)).cast("double")).alias("rate"))
