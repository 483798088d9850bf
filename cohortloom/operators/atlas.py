"""Parcels, networks and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.ordering import percentiles
from cohortloom.operators.temporal import join_stats


def dominant_label(atlas: DataFrame, parcel: str, network: str) -> DataFrame:
    """Most frequent network per parcel, the smallest one on ties."""
    c = atlas.groupBy(parcel, network).agg(F.count("*").alias("n"))
    return c.groupBy(parcel).agg(
        F.min_by(network, F.struct(-F.col("n"), F.col(network))).alias(network), F.max("n").alias("n")
    )


def parcellate(signal: DataFrame, atlas: DataFrame, vertex: str, parcel: str, keys, value: str, mask=None) -> DataFrame:
    """Mean over unmasked vertices per parcel and key."""
    a = atlas if mask is None else atlas.filter(mask)
    return signal.join(a.select(vertex, parcel), vertex).groupBy(*keys, parcel).agg(F.avg(value).alias("value"))


def attach_network(df: DataFrame, atlas: DataFrame, parcel: str) -> DataFrame:
    return df.join(atlas, parcel)


def restrict(df: DataFrame, mask: DataFrame, parcel) -> DataFrame:
    return df.join(mask, parcel, "left_semi")


def expand(df: DataFrame, domain: DataFrame, keys, fills: dict) -> DataFrame:
    """All members of the domain; columns get their fill where ``df`` has no row."""
    out = domain.join(df, keys, "left")
    return out.fillna({c: v for c, v in fills.items() if v is not None})


def min_members(members: DataFrame, keys, n: int, value: str, fill) -> DataFrame:
    """Mean per group, ``fill`` for a group with fewer than ``n`` members."""
    g = members.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("value"))
    return g.withColumn("value", F.when(F.col("n") >= n, F.col("value")).otherwise(fill))


def rollup(values: DataFrame, atlas: DataFrame, parcel: str, network: str, value: str, policy: str, how: str = "avg", mask: DataFrame | None = None) -> DataFrame:
    """Network roll-up of a parcel map.

    ``policy='masked'`` averages the parcels of the mask only; ``policy='zero'`` counts parcels
    outside the mask (or without a value) as 0. An empty network reports 0.
    """
    f = {"avg": F.avg, "sum": F.sum}[how]
    v = values if mask is None else restrict(values, mask, parcel)
    j = atlas.select(parcel, network).join(v.select(parcel, value), parcel, "left")
    if policy == "zero":
        j = j.fillna(0.0, [value])
    elif policy != "masked":
        raise ValueError("policy is 'masked' or 'zero'")
    return j.groupBy(network).agg(F.coalesce(f(value), F.lit(0.0)).alias("value"), F.count(value).alias("n"))


def signed_rollup(sig: DataFrame, atlas: DataFrame, parcel: str, network: str, sign: str) -> DataFrame:
    """Significant parcels per network, positive and negative apart."""
    j = atlas.select(parcel, network).join(sig.select(parcel, sign), parcel, "left")
    s = F.coalesce(F.col(sign), F.lit(0))
    return j.groupBy(network).agg(
        F.sum(F.greatest(s, F.lit(0))).cast("bigint").alias("n_positive"),
        F.sum(F.least(s, F.lit(0))).cast("bigint").alias("n_negative"),
    )


def sig_map(df: DataFrame, stat: str, p: str, alpha: float, out: str = "sig") -> DataFrame:
    """Sign of the statistic where the corrected p is below ``alpha``, else 0."""
    s = F.when(F.col(p) < alpha, F.signum(stat)).otherwise(0.0)
    return df.withColumn(out, s.cast("int"))


def network_scores(scores: DataFrame, sig: DataFrame, groups: DataFrame, subject: str, parcel: str, network: str, family: str, families, value: str) -> DataFrame:
    """Mean score per subject and network family over significant parcels; empty gives NULL.

    ``groups`` maps a network to its family.
    """
    used = sig.filter("sig <> 0").select(parcel, network).join(groups, network)
    j = scores.join(used, parcel, "left")
    return j.groupBy(subject).agg(*[F.avg(F.when(F.col(family) == f, F.col(value))).alias(str(f)) for f in families])


def network_values(means: DataFrame, sig: DataFrame, families: DataFrame, parcel: str, network: str) -> DataFrame:
    """Group-mean values of the significant parcels, listed with their network family."""
    return means.join(sig.filter("sig <> 0").select(parcel, network), parcel).join(families, network)


def signed_overlap(a: DataFrame, b: DataFrame, parcel: str, alpha: float) -> DataFrame:
    """Parcel-wise product of two sign maps; inputs hold (parcel, t, p)."""
    s = lambda t, p: F.when(F.col(p) < alpha, F.signum(t)).otherwise(0.0)
    j = a.select(parcel, F.col("t").alias("t_a"), F.col("p").alias("p_a")).join(
        b.select(parcel, F.col("t").alias("t_b"), F.col("p").alias("p_b")), parcel
    )
    return j.withColumn("overlap", (s("t_a", "p_a") * s("t_b", "p_b")).cast("int"))


def overlap_counts(overlap: DataFrame) -> DataFrame:
    return overlap.agg(
        F.count_if(F.col("overlap") > 0).alias("concordant"),
        F.count_if(F.col("overlap") < 0).alias("discordant"),
        F.count("*").alias("n"),
    )


def overlap_table(overlap: DataFrame, atlas_a: DataFrame, atlas_b: DataFrame, parcel: str) -> DataFrame:
    """Overlapping parcels with both networks, both statistics and their mean magnitude."""
    j = overlap.filter("overlap <> 0").join(atlas_a, parcel).join(atlas_b, parcel)
    return j.withColumn("mean_abs_t", (F.abs("t_a") + F.abs("t_b")) / 2)


def mask_union(a: DataFrame, b: DataFrame, parcel: str) -> DataFrame:
    return a.select(parcel).union(b.select(parcel)).distinct()


def mask_except(a: DataFrame, b: DataFrame, parcel: str) -> DataFrame:
    return a.select(parcel).distinct().join(b.select(parcel), parcel, "left_anti")


def mask_intersect(a: DataFrame, b: DataFrame, parcel: str) -> DataFrame:
    return a.select(parcel).intersect(b.select(parcel))


def pair_maps(a: DataFrame, b: DataFrame, parcel: str, va: str, vb: str, drop_zero: bool = False) -> DataFrame:
    """Two maps joined by parcel; pairs with a missing side (or a zero, if asked) are dropped."""
    j = a.select(parcel, va).join(b.select(parcel, vb), parcel).dropna()
    return j.filter((F.col(va) != 0) & (F.col(vb) != 0)) if drop_zero else j


def join_ratings(loadings: DataFrame, ratings: DataFrame, label, word: str) -> DataFrame:
    """Loadings joined with word ratings on the cleaned label; unmatched labels drop out."""
    return loadings.withColumn(word, label).join(ratings, word)


def weight_rescale(df: DataFrame, keys, value: str) -> DataFrame:
    """Position of the value between minus and plus the 90th percentile of its magnitude
    (0.5 is zero), and |z| for ranking."""
    keys = list(keys)
    a = df.withColumn("_abs", F.abs(value))
    q = percentiles(a, keys, "_abs", {"_q": 0.9})
    s = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    j = join_stats(join_stats(df, q, keys), s, keys)
    return j.withColumn("rescaled", F.when(F.col("_q") > 0, (F.col(value) + F.col("_q")) / (2 * F.col("_q")))).withColumn(
        "abs_z", F.when(F.col("_s") > 0, F.abs((F.col(value) - F.col("_m")) / F.col("_s")))
    ).drop("_q", "_m", "_s")
