"""Ranks, running totals, percentiles and top-k that never sort a whole group in one task.

Values are first counted per distinct value (map-side), then placed in ordered buckets by a
fixed monotone function of the value. Windows run inside a bucket; the totals of the earlier
buckets are added by a join. A group that holds most of the rows is thereby spread over as many
tasks as it has buckets. The bucket depends on the value alone, so a recomputed task gives the
same answer.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.scalar import col, finite

SLICES = 4096  # ordered buckets per power of two


def null_safe_join(df: DataFrame, other: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on ``keys`` where a NULL key matches a NULL key; the keys appear once."""
    right = other.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    joined = df.join(right, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_key_{k}" for k in keys])


def order_bucket(c, slices: int = SLICES) -> Column:
    """Monotone map from a finite number to a bucket number."""
    v = col(c).cast("double")
    a = F.abs(v)
    e = F.greatest(F.floor(F.log2(a)), F.lit(-1022))
    part = F.floor((a / F.pow(F.lit(2.0), e.cast("double")) - 1) * slices)
    mag = (e + 1075) * slices + F.greatest(F.least(part, F.lit(slices - 1)), F.lit(0)) + 1
    return F.when(v == 0, F.lit(0)).when(v > 0, mag).otherwise(-mag).cast("bigint")


def _by(keys) -> list:
    return list(keys) or [F.lit(0)]


def running_totals(df: DataFrame, keys, order: str, values: dict[str, Column]) -> DataFrame:
    """Per distinct (keys, order): each value summed, its sum over smaller orders, its group sum.

    Output columns per value ``v``: ``v``, ``below_v``, ``all_v``; and ``_bucket``.
    """
    keys = list(keys)
    cells = (
        df.filter(finite(order).isNotNull())
        .groupBy(*keys, order)
        .agg(*[F.sum(c).alias(n) for n, c in values.items()])
        .withColumn("_bucket", order_bucket(order))
    )
    before = Window.partitionBy(*_by(keys)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*_by(keys))
    offsets = cells.groupBy(*keys, "_bucket").agg(*[F.sum(n).alias(n) for n in values])
    offsets = offsets.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in values],
        *[F.sum(n).over(whole).alias(f"all_{n}") for n in values],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    out = cells.select("*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_in_{n}") for n in values])
    out = null_safe_join(out, offsets, [*keys, "_bucket"])
    return out.select(
        *keys,
        order,
        "_bucket",
        *values,
        *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(f"below_{n}") for n in values],
        *[f"all_{n}" for n in values],
    )


def rank_table(df: DataFrame, keys, order: str) -> DataFrame:
    """Per distinct value: its count ``_n``, number of smaller rows ``_below``, average rank
    ``_avg_rank``, group size ``_total``."""
    t = running_totals(df, keys, order, {"_n": F.lit(1).cast("bigint")})
    return t.select(
        *keys,
        order,
        "_n",
        F.col("below__n").alias("_below"),
        (F.col("below__n") + (F.col("_n") + 1) / 2).alias("_avg_rank"),
        F.col("all__n").alias("_total"),
    )


def percentiles(df: DataFrame, keys, value: str, ps: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per entry of ``ps``."""
    t = rank_table(df, keys, value)
    aggs = []
    for name, p in ps.items():
        h = F.lit(float(p)) * (F.col("_total") - 1)
        for tag, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("_below") <= pos) & (pos < F.col("_below") + F.col("_n"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{tag}_{name}"))
    g = t.groupBy(*keys).agg(F.max("_total").alias("_n"), *aggs)
    out = []
    for name, p in ps.items():
        h = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return g.select(*keys, *out)


def median_by(df: DataFrame, keys, value: str, out: str = "median") -> DataFrame:
    return percentiles(df, keys, value, {out: 0.5})


def top_k(df: DataFrame, keys, order_cols, k: int) -> DataFrame:
    """First ``k`` rows per group. Spark keeps only ``k`` rows per task before the shuffle."""
    w = Window.partitionBy(*_by(keys)).orderBy(*order_cols)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_fraction(df: DataFrame, keys, value: str, frac: float) -> DataFrame:
    """Rows whose value ranks within the first ``floor(n * frac)`` of its group, largest first.

    Ties at the boundary are kept together only if the whole tie fits.
    """
    t = rank_table(df, keys, value)
    inside = t.filter(F.col("_total") - F.col("_below") <= F.floor(F.col("_total") * frac)).select(*keys, value)
    return df.join(inside, [*keys, value], "left_semi")


def rank_by(df: DataFrame, keys, value: str, tie: str, out: str = "position") -> DataFrame:
    """Position within a small group (networks, regions), largest first."""
    w = Window.partitionBy(*_by(keys)).orderBy(F.col(value).desc(), F.col(tie))
    return df.withColumn(out, F.row_number().over(w))


def argmax_by(df: DataFrame, keys, score: str, param: str, index: str) -> DataFrame:
    """Parameter with the highest score, the first one on ties."""
    return df.groupBy(*keys).agg(
        F.max_by(param, F.struct(F.col(score), -F.col(index))).alias(param),
        F.max(score).alias(score),
    )


def best_model(df: DataFrame, model: str, smaller_better, larger_better) -> DataFrame:
    """Best model per fit index; some indices are better small, some better large."""
    cols = [*smaller_better, *larger_better]
    long = df.unpivot([model], cols, "measure", "value")
    low = long.filter(F.col("measure").isin(*smaller_better)).groupBy("measure").agg(
        F.min_by(model, F.struct("value", model)).alias("best_model"), F.min("value").alias("best_value")
    )
    high = long.filter(F.col("measure").isin(*larger_better)).groupBy("measure").agg(
        F.min_by(model, F.struct(-F.col("value"), F.col(model))).alias("best_model"),
        F.max("value").alias("best_value"),
    )
    return low.unionByName(high)


def renumber(df: DataFrame, keys, order: str, out: str = "frame") -> DataFrame:
    """Consecutive frame names ``f00001`` in the order of a unique frame position."""
    t = rank_table(df.select(*keys, order).distinct(), keys, order)
    names = t.select(*keys, order, F.concat(F.lit("f"), F.lpad((F.col("_below") + 1).cast("string"), 5, "0")).alias(out))
    return df.join(names, [*keys, order])


def truncate_runs(df: DataFrame, keys, order_cols, n: int) -> DataFrame:
    """Keep the first ``n`` rows of every run."""
    return top_k(df, keys, order_cols, n).drop("rank")
