"""Characterisation of clusters of cases."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from cohortloom.functions import tails
from cohortloom.functions.scalar import intercept, slope
from cohortloom.functions.small import about, unpack
from cohortloom.operators.gram import key_fields, map_rows, moments
from cohortloom.operators.normative import interp_join
from cohortloom.operators.stats import anova, bh, chi_square, fisher_exact, group_moments, two_sample_t


def characterise(df: DataFrame, cluster: str, age: str, male: str) -> DataFrame:
    """Size, age moments (ddof 0) and share of males per cluster."""
    return df.groupBy(cluster).agg(
        F.count("*").alias("n"), F.avg(age).alias("mean_age"), F.stddev_pop(age).alias("sd_age"), F.avg(F.col(male).cast("double")).alias("male_ratio")
    )


def demographic_tests(df: DataFrame, cluster: str, age: str, male: str, pair=None) -> DataFrame:
    """Analysis of variance on age and chi-square on sex; for two clusters, or the two that ``pair`` names,
    the pooled t of age and the exact test of sex (statistic: odds ratio), the smaller name first."""
    if pair is None:
        names = df.filter(F.col(cluster).isNotNull()).select(cluster).distinct().limit(3).collect()
        pair = sorted(r[0] for r in names) if len(names) == 2 else None
    if pair is not None:
        first, second = pair
        two = df.filter(F.col(cluster).isin(first, second)).withColumn("_first", F.col(cluster) == F.lit(first))
        a = two_sample_t(two, [], cluster, first, second, age).select(F.lit("age").alias("test"), F.col("t").alias("stat"), "p")
        return a.unionByName(fisher_exact(two, [], "_first", male).select(F.lit("sex").alias("test"), F.col("odds").alias("stat"), "p"))
    a = anova(df, [], cluster, age).select(F.lit("age").alias("test"), F.col("f").alias("stat"), "p")
    c = chi_square(df, [], cluster, male, yates=True).select(F.lit("sex").alias("test"), F.col("chi2").alias("stat"), "p")
    return a.unionByName(c)


def cluster_features(flags: DataFrame, cluster: str, cols) -> DataFrame:
    return flags.groupBy(cluster).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])


def cluster_profile(df: DataFrame, cluster: str, cols) -> DataFrame:
    """Mean and sample deviation of every profile variable per cluster."""
    long = df.unpivot([cluster], list(cols), "variable", "value")
    return long.groupBy(cluster, "variable").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def _domains(domains: dict) -> Column:
    pairs = [x for d, items in domains.items() for i in items for x in (F.lit(i), F.lit(d))]
    return F.element_at(F.create_map(*pairs), F.col("item"))


def item_tests(df: DataFrame, cluster: str, domains: dict, small_family: bool = False) -> DataFrame:
    """Analysis of variance per item (equal to the squared pooled t for two clusters), adjusted
    within each domain."""
    items = [i for v in domains.values() for i in v]
    long = df.unpivot([cluster], items, "item", "value")
    t = anova(long, ["item"], cluster, "value").withColumn("domain", _domains(domains))
    return bh(t, ["domain"], "p", "p_adj", small_family)


def manova(df: DataFrame, keys, cluster: str, items) -> DataFrame:
    """Wilks' lambda of the items between clusters with its F approximation (Rao)."""
    g = moments(df.dropna(subset=list(items)), [*keys, cluster], items)
    keys = list(keys)
    rows = g.groupBy(*keys).agg(F.collect_list("_gram").alias("gs"), F.collect_list("_mean").alias("ms"))  # one matrix per cluster
    cols = ("wilks", "f", "df1", "df2")
    schema = StructType([*key_fields(g, keys), StructField("n", LongType()), *[StructField(c, DoubleType()) for c in cols]])
    p = len(items)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[keys].reset_index(drop=True)
        rec = []
        for gs, ms in zip(pdf["gs"], pdf["ms"], strict=True):
            m, mean = unpack(np.vstack(list(gs))), np.vstack(list(ms))
            m = about(m[:, 0, 0], mean, m, mean[0])
            inside = lambda q: q[1:, 1:] - np.outer(q[0, 1:], q[0, 1:]) / q[0, 0]
            within, total = sum(inside(q) for q in m), inside(m.sum(0))
            n, k = m[:, 0, 0].sum(), len(m)
            lam = np.exp(np.linalg.slogdet(within)[1] - np.linalg.slogdet(total)[1])
            q = k - 1
            den = p * p + q * q - 5
            s = np.sqrt((p * p * q * q - 4) / den) if den > 0 else 1.0
            root = lam ** (1 / s)
            df1 = p * q
            df2 = (n - 1 - (p + q + 1) / 2) * s - (p * q - 2) / 2
            rec.append((int(n), lam, (1 - root) / root * df2 / df1, float(df1), df2))
        return pd.concat([out, pd.DataFrame(rec, columns=["n", *cols])], axis=1)

    return map_rows(rows, keys, step, schema, spread=False).withColumn("p", tails.f_tail("f", "df1", "df2"))


def category_tests(df: DataFrame, cluster: str, categories: dict, first=None, small_family: bool = False) -> DataFrame:
    """Cluster against each diagnosis category: exact test for two clusters, chi-square for more;
    adjusted over categories. ``first`` names one of exactly two clusters."""
    flags = df.select(cluster, *[c.alias(n) for n, c in categories.items()])
    long = flags.select(cluster, *[F.col(n).cast("int").alias(n) for n in categories]).unpivot([cluster], list(categories), "category", "flag")
    if first is not None:
        t = fisher_exact(long.withColumn("_a", F.col(cluster) == F.lit(first)).withColumn("_b", F.col("flag") == 1), ["category"], "_a", "_b")
        t = t.select("category", F.col("odds").alias("stat"), "p")
    else:
        t = chi_square(long, ["category"], cluster, "flag").select("category", F.col("chi2").alias("stat"), "p")
    return bh(t, [], "p", "p_adj", small_family)


def trend_direction(df: DataFrame, keys, group: str, case, control, z: str, alpha: float = 0.05) -> DataFrame:
    """Welch test of cases against controls, read as below / above / no_difference."""
    t = two_sample_t(df, keys, group, case, control, z, welch=True)
    word = F.when(F.col("p") < alpha, F.when(F.col("t") < 0, "below").otherwise("above")).otherwise("no_difference")
    return t.withColumn("direction", word)


def adherence(cases: DataFrame, trajectories: DataFrame, directions: DataFrame, variable: str, age: str, value: str, buffer: float = 0.5) -> DataFrame:
    """Share of cases on the trend side of the controls' trajectory, with its binomial p."""
    j = interp_join(cases.dropna(subset=[age, value]), trajectories, [variable], age, "age", "mu", buffer, "_mu")
    j = j.join(directions.select(variable, "direction"), variable).filter(F.col("direction").isin("below", "above"))
    follows = F.when(F.col("direction") == "below", F.col(value) < F.col("_mu")).otherwise(F.col(value) > F.col("_mu"))
    g = j.groupBy(variable, "direction").agg(F.count("*").alias("n_total"), F.count_if(follows).alias("n_following"))
    return g.withColumn("pct_adherence", 100 * F.col("n_following") / F.col("n_total")).withColumn(
        "p", tails.binomial_p(F.col("n_following").cast("double"), F.col("n_total").cast("double"))
    )


def interaction_anova(df: DataFrame, keys, cluster: str, x: str, y: str, small_family: bool = False) -> DataFrame:
    """``y ~ x * cluster``: type-II F of x, cluster and their interaction, adjusted over keys.

    Needs only per-cluster sums, from which the error of each nested model follows.
    """
    xx, yy = F.col(x).cast("double"), F.col(y).cast("double")
    s = df.dropna(subset=[x, y, cluster]).groupBy(*keys, cluster).agg(
        F.count("*").alias("n"), F.avg(xx).alias("mx"), F.avg(yy).alias("my"), F.var_pop(xx).alias("vx"), F.var_pop(yy).alias("vy"), F.covar_pop(xx, yy).alias("cxy")
    )
    n = F.col("n")
    sxx, syy, sxy = n * F.col("vx"), n * F.col("vy"), n * F.col("cxy")
    g = s.groupBy(*keys).agg(
        F.sum("n").alias("n_total"),
        F.count("*").alias("k"),
        F.sum(syy).alias("_wyy"),
        F.sum(sxx).alias("_wxx"),
        F.sum(sxy).alias("_wxy"),
        F.sum(F.when(sxx > 0, sxy * sxy / sxx).otherwise(0.0)).alias("_own"),
        (F.sum(sxx + n * F.col("mx") * F.col("mx")) - F.sum(n * F.col("mx")) * F.sum(n * F.col("mx")) / F.sum("n")).alias("_txx"),
        (F.sum(syy + n * F.col("my") * F.col("my")) - F.sum(n * F.col("my")) * F.sum(n * F.col("my")) / F.sum("n")).alias("_tyy"),
        (F.sum(sxy + n * F.col("mx") * F.col("my")) - F.sum(n * F.col("mx")) * F.sum(n * F.col("my")) / F.sum("n")).alias("_txy"),
    )
    full = F.col("_wyy") - F.col("_own")
    parallel = F.col("_wyy") - F.try_divide(F.col("_wxy") * F.col("_wxy"), F.col("_wxx"))
    x_only = F.col("_tyy") - F.try_divide(F.col("_txy") * F.col("_txy"), F.col("_txx"))
    k, dof = F.col("k"), (F.col("n_total") - 2 * F.col("k")).cast("double")
    mse = F.try_divide(full, dof)
    g = g.withColumns(
        {
            "age_f": F.try_divide(F.col("_wyy") - parallel, mse),
            "cluster_f": F.try_divide(x_only - parallel, (k - 1) * mse),
            "interaction_f": F.try_divide(parallel - full, (k - 1) * mse),
            "r2": 1 - F.try_divide(full, F.col("_tyy")),
        }
    )
    d1 = (k - 1).cast("double")
    g = g.withColumns(
        {"age_p": tails.f_tail("age_f", F.lit(1.0), dof), "cluster_p": tails.f_tail("cluster_f", d1, dof), "interaction_p": tails.f_tail("interaction_f", d1, dof)}
    )
    g = g.select(*keys, "n_total", "k", "age_f", "age_p", "cluster_f", "cluster_p", "interaction_f", "interaction_p", "r2")
    return bh(bh(g, [], "interaction_p", "interaction_q", small_family), [], "cluster_p", "cluster_q", small_family)


def cluster_slopes(df: DataFrame, keys, cluster: str, x: str, y: str) -> DataFrame:
    return df.dropna(subset=[x, y]).groupBy(*keys, cluster).agg(
        F.count("*").alias("n"), slope(y, x).alias("slope"), intercept(y, x).alias("intercept")
    )


def item_tests_with_controls(df: DataFrame, group: str, items, alpha: float = 0.05):
    """Analysis of variance over controls and clusters, and Tukey's pairs of the significant items.

    Returns (tests, pairs). Pairs are formed between group means, never between rows.
    """
    long = df.unpivot([group], list(items), "item", "value")
    tests = anova(long, ["item"], group, "value")
    m = group_moments(long, ["item"], group, "value").select("item", F.col(group).alias("g"), "n", "mean")
    mse = tests.filter(F.col("p") < alpha).select(
        "item", (F.col("ss_within") / (F.col("n_total") - F.col("k"))).alias("_mse"), "k", (F.col("n_total") - F.col("k")).cast("double").alias("dof")
    )
    a = m.select("item", F.col("g").alias("group_a"), F.col("n").alias("_na"), F.col("mean").alias("_ma"))
    b = m.select("item", F.col("g").alias("group_b"), F.col("n").alias("_nb"), F.col("mean").alias("_mb"))
    j = a.join(b, "item").filter(F.col("group_a") < F.col("group_b")).join(mse, "item")
    j = j.withColumn("mean_diff", F.col("_mb") - F.col("_ma")).withColumn(
        "q", F.try_divide(F.abs("mean_diff"), F.sqrt(F.col("_mse") / 2 * (1 / F.col("_na") + 1 / F.col("_nb"))))
    )
    pairs = j.withColumn("p", tails.tukey_tail("q", F.col("k").cast("double"), "dof")).select("item", "group_a", "group_b", "mean_diff", "q", "p")
    return tests, pairs


