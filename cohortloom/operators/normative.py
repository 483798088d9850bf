"""Normative models of controls, deviations, trajectories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from cohortloom.functions.scalar import finite, metric_average
from cohortloom.functions.small import condition_on, unpack
from cohortloom.operators.cohort import complete_cases
from cohortloom.operators.gram import gram_narrow, map_rows
from cohortloom.operators.ordering import null_safe_join, order_bucket, percentiles
from cohortloom.operators.temporal import join_stats

# Gain in AIC that the smooth must bring, prediction and confidence multipliers, grid.
DELTA_AIC = 2.0
PREDICTION = 1.645
CONFIDENCE = 1.96
GRID = 100


def wiggle(x: Column, lo: Column, mid: Column, hi: Column) -> Column:
    """The one non-linear column of a natural cubic spline with three knots, on a unit scale."""
    span = hi - lo
    u, m = F.try_divide(x - lo, span), F.try_divide(mid - lo, span)
    cube = lambda k: F.pow(F.greatest(u - k, F.lit(0.0)), 3.0)
    return (cube(F.lit(0.0)) - cube(F.lit(1.0))) - F.try_divide(cube(m) - cube(F.lit(1.0)), 1 - m)


def _reml(szz, szy, syy, df):
    """Penalty that maximises the restricted likelihood of one random column, on a log grid."""
    best = None
    for log_l in np.linspace(-12, 12, 241):
        lam = szz * np.exp(log_l)
        rss_pen = max(syy - szy * szy / (szz + lam), 1e-300)
        cost = df * np.log(rss_pen) + np.log1p(szz / lam)
        if best is None or cost < best[0]:
            best = (cost, lam)
    return best[1]


def normative_fit(controls: DataFrame, y_cols, age: str, sex: str, delta: float = DELTA_AIC) -> DataFrame:
    """One row per variable: linear ``age + sex`` or smooth age + sex, whichever the AIC supports.

    ``coef`` = (1, age, sex, wiggle); ``cov`` its packed covariance; ``knots`` of the smooth.
    """
    d = controls.dropna(subset=[age, sex, *y_cols])
    k = percentiles(d, [], age, {"lo": 0.0, "mid": 0.5, "hi": 1.0})
    d = join_stats(d, k, []).withColumn("_w", wiggle(F.col(age), F.col("lo"), F.col("mid"), F.col("hi")))
    long = d.unpivot([age, sex, "_w"], list(y_cols), "variable", "_y")
    g = join_stats(gram_narrow(long, ["variable"], [age, sex, "_w", "_y"]), k, [])
    vec = ArrayType(DoubleType())
    schema = StructType(
        [
            StructField("variable", StringType()),
            StructField("n", LongType()),
            StructField("model", StringType()),
            StructField("aic_linear", DoubleType()),
            StructField("aic_smooth", DoubleType()),
            StructField("sigma", DoubleType()),
            StructField("r2", DoubleType()),
            StructField("coef", vec),
            StructField("cov", vec),
            StructField("knots", vec),
        ]
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for name, v, lo, mid, hi in zip(pdf["variable"], pdf["_gram"], pdf["lo"], pdf["mid"], pdf["hi"], strict=True):
            m = unpack(v)
            n, base, w, y = m[0, 0], [0, 1, 2], 3, 4
            xtx = m[np.ix_(base, base)]
            p = np.linalg.matrix_rank(xtx, hermitian=True)
            s = condition_on(m, base, [w, y])
            szz, szy, syy = s[0, 0], s[0, 1], s[1, 1]
            total = m[y, y] - m[0, y] ** 2 / n
            aic = lambda rss, edf: n * np.log(2 * np.pi * rss / n) + n + 2 * (edf + 1)
            lin = aic(syy, p)
            if szz > 1e-12 * max(m[w, w], 1e-300):
                lam = _reml(szz, szy, syy, n - p)
                b = szy / (szz + lam)
                rss = syy - 2 * b * szy + b * b * szz
                edf = p + szz / (szz + lam)
                smooth = aic(rss, edf)
            else:
                lam, b, rss, edf, smooth = np.inf, 0.0, syy, p, np.inf
            curved = lin - smooth > delta
            if not curved:
                lam, b, rss, edf = np.inf, 0.0, syy, p
            beta = np.linalg.pinv(xtx, hermitian=True) @ (m[base, y] - m[base, w] * b)
            sigma2 = rss / (n - edf)
            full = m[:4, :4].copy()
            if curved:
                full[3, 3] += lam
                cov = sigma2 * np.linalg.pinv(full, hermitian=True)
            else:
                cov = np.zeros((4, 4))
                cov[:3, :3] = sigma2 * np.linalg.pinv(xtx, hermitian=True)
            rows.append(
                (name, int(n), "nonlinear" if curved else "linear", lin, smooth if np.isfinite(smooth) else None,
                 np.sqrt(sigma2), 1 - rss / total, np.append(beta, b), cov.ravel(), np.array([lo, mid, hi]))
            )
        return pd.DataFrame(rows, columns=[f.name for f in schema])

    return map_rows(g, ["variable"], fit, schema)


def _basis(age: Column, sex: Column) -> Column:
    knots = F.col("knots")
    return F.array(F.lit(1.0), age.cast("double"), sex.cast("double"), wiggle(age, knots[0], knots[1], knots[2]))


def _predict(model_basis: str) -> Column:
    return F.aggregate(F.zip_with("coef", model_basis, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def deviation(df: DataFrame, model: DataFrame, row_id, y_cols, age: str, sex: str) -> DataFrame:
    """Long ``(row_id, variable, y, mu, z)`` with z = (y - mu) / sigma."""
    long = df.dropna(subset=[age, sex]).unpivot([*row_id, age, sex], list(y_cols), "variable", "y").filter("y is not null")
    j = long.join(model.select("variable", "coef", "knots", "sigma"), "variable")
    j = j.withColumn("_b", _basis(F.col(age), F.col(sex))).withColumn("mu", _predict("_b"))
    return j.select(*row_id, "variable", "y", "mu", F.try_divide(F.col("y") - F.col("mu"), F.col("sigma")).alias("z"))


def trajectory(model: DataFrame, sex_value: float = 0.0, n: int = GRID) -> DataFrame:
    """Prediction over an age grid with standard error, confidence and prediction bands."""
    knots = F.col("knots")
    step = (knots[2] - knots[0]) / (n - 1)
    d = model.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("age", knots[0] + F.col("_i") * step)
    d = d.withColumn("_b", _basis(F.col("age"), F.lit(sex_value))).withColumn("mu", _predict("_b"))
    quad = sum((F.col("_b")[a] * F.col("_b")[b] * F.col("cov")[4 * a + b] for a in range(4) for b in range(4)), F.lit(0.0))
    d = d.withColumn("se", F.sqrt(F.greatest(quad, F.lit(0.0))))
    ci, pi = CONFIDENCE * F.col("se"), PREDICTION * F.col("sigma")
    return d.select(
        "variable", F.col("_i").alias("point"), "age", "mu", "se", "sigma",
        (F.col("mu") - ci).alias("ci_lower"), (F.col("mu") + ci).alias("ci_upper"),
        (F.col("mu") - pi).alias("pi_lower"), (F.col("mu") + pi).alias("pi_upper"),
    )


def interp_join(df: DataFrame, grid: DataFrame, keys, x: str, gx: str, gy: str, buffer: float, out: str = "y_grid") -> DataFrame:
    """Piecewise-linear lookup on a grid of any length, clamped at its ends; rows farther than ``buffer``
    outside are dropped, as are rows without a number in ``x`` or without a grid.

    A sorted merge in ordered buckets of the value: inside a bucket a window carries the last and the next grid point to
    every row, and the last point of earlier and the first of later buckets come by a join of one row for each bucket.
    Of grid points with one ``gx`` the first by ``gy`` stands for what is above it and the last for what is below.
    """
    keys = list(keys)
    value = F.col(x).cast("double")
    point = F.struct(F.col(gx).cast("double").alias("x"), F.col(gy).cast("double").alias("y"))
    points = grid.filter(finite(gx).isNotNull()).select(*keys, F.col(gx).cast("double").alias("_x"), point.alias("_p"), order_bucket(gx).alias("_bucket"))
    rows = df.filter(finite(x).isNotNull()).select(*keys, value.alias("_x"), F.struct(*df.columns).alias("_row"), order_bucket(x).alias("_bucket"))
    both = points.unionByName(rows, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_x", F.col("_p.x"), F.col("_p.y"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    met = both.withColumns({"_a": F.last("_p", True).over(upto), "_b": F.first("_p", True).over(onward)}).filter("_row is not null")
    edges = points.groupBy(*keys, "_bucket").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    edges = edges.unionByName(rows.select(*keys, "_bucket").distinct(), allowMissingColumns=True).groupBy(*keys, "_bucket").agg(F.first("_first", True).alias("_first"), F.first("_last", True).alias("_last"))
    chain = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket")
    edges = edges.select(
        *keys,
        "_bucket",
        F.last("_last", True).over(chain.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", True).over(chain.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    j = null_safe_join(met, edges, [*keys, "_bucket"])
    a, b = F.coalesce("_a", "_before"), F.coalesce("_b", "_after")
    v = F.col("_x")
    slope = F.try_divide(b["y"] - a["y"], b["x"] - a["x"])
    y = F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(a["y"] + F.coalesce(slope, F.lit(0.0)) * (v - a["x"]))
    near = F.when(a.isNull(), v >= b["x"] - buffer).when(b.isNull(), v <= a["x"] + buffer).otherwise(True)
    return j.filter((a.isNotNull() | b.isNotNull()) & near).select("_row.*", y.alias(out))


def build_analysis_table(z: DataFrame, row_id: str, pairs: dict, items, group: str) -> DataFrame:
    """Complete cases with averaged metrics (first one sign-turned) and items z-scored over the pool.

    ``pairs`` maps an output name to its two columns.
    """
    cols = [c for p in pairs.values() for c in p]
    d = complete_cases(z, [*cols, *items])
    d = d.withColumns({n: metric_average(a, b) for n, (a, b) in pairs.items()})
    s = d.agg(*[f(c).alias(f"_{n}_{c}") for c in items for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    d = join_stats(d, s, [])
    d = d.withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in items})
    return d.select(row_id, group, *cols, *pairs, *items)


