"""Statistical tests. Each reduces the rows to sums, counts or running totals per key; the tail
probability is then read for one row per test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import scalar as X
from cohortloom.functions import tails
from cohortloom.operators.ordering import _by, null_safe_join, rank_table, running_totals
from cohortloom.operators.temporal import join_stats


def _r_to_p(df: DataFrame, r: str = "r", n: str = "n", p: str = "p") -> DataFrame:
    rr, dof = F.col(r), F.col(n) - 2
    t = F.when(F.abs(rr) < 1, rr * F.sqrt(dof / (1 - rr * rr)))
    # Two pairs always lie on a line and say nothing; fewer have no correlation.
    return df.withColumn(p, F.when(F.col(n) == 2, F.when(rr.isNotNull(), 1.0)).when(F.col(n) < 2, None).when(F.abs(rr) >= 1, 0.0).otherwise(tails.two_sided_t(t, dof)))


def pearson(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """r, n and two-sided p per key over rows where both sides are present."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = both.groupBy(*keys).agg(
        F.count("*").alias("n"), X.corr(x, y).alias("r")
    )
    return _r_to_p(g)


def spearman(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Pearson on average ranks, from one row per distinct (x, y)."""
    keys = list(keys)
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = both.groupBy(*keys, x, y).agg(F.count("*").alias("_c"))
    rx = rank_table(both, keys, x).select(*keys, x, F.col("_avg_rank").alias("_rx"), "_total")
    ry = rank_table(both, keys, y).select(*keys, y, F.col("_avg_rank").alias("_ry"))
    j = cells.join(rx, [*keys, x]).join(ry, [*keys, y])
    mid = (F.col("_total") + 1) / 2
    u, v, c = F.col("_rx") - mid, F.col("_ry") - mid, F.col("_c")
    g = j.groupBy(*keys).agg(
        F.sum("_c").alias("n"),
        F.sum(c * u * v).alias("_uv"),
        F.sum(c * u * u).alias("_uu"),
        F.sum(c * v * v).alias("_vv"),
    )
    g = g.withColumn("r", F.when((F.col("_uu") > 0) & (F.col("_vv") > 0), F.col("_uv") / F.sqrt(F.col("_uu") * F.col("_vv"))))
    return _r_to_p(g.select(*keys, "n", "r"))


def concordance(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Counts of concordant and tied pairs per key, without forming pairs.

    Two rows with different x differ first at one bit of the dense rank of x. For every bit the
    rows that share the higher bits form a node, and the pairs of a node are counted by running
    totals over y: O(n log n) rows, all of them shuffled by (bit, node, bucket of y).
    """
    keys = list(keys)
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = both.groupBy(*keys, x, y).agg(F.count("*").alias("_c"))
    levels = running_totals(both.groupBy(*keys, x).agg(F.count("*").alias("_m")), keys, x, {"_one": F.lit(1).cast("bigint")})
    levels = levels.select(*keys, x, F.col("below__one").alias("_rank"), F.expr("length(bin(all__one - 1))").alias("_bits"))
    bits = cells.join(levels, [*keys, x]).withColumn("_bit", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)))
    bits = bits.withColumn("_node", F.expr("shiftright(_rank, _bit + 1)")).withColumn(
        "_upper", F.expr("shiftright(_rank, _bit) & 1") == 1
    )
    run = running_totals(
        bits,
        [*keys, "_bit", "_node"],
        y,
        {
            "_lo": F.when(F.col("_upper"), 0).otherwise(F.col("_c")),
            "_hi": F.when(F.col("_upper"), F.col("_c")).otherwise(0),
        },
    )
    conc = run.groupBy(*keys).agg(F.sum(F.col("_hi").cast("double") * F.col("below__lo")).alias("concordant"))

    def ties(cols, name):
        g = both.groupBy(*keys, *cols).agg(F.count("*").cast("double").alias("_t"))
        t = F.col("_t")
        return g.groupBy(*keys).agg(
            F.sum("_t").alias(f"_n_{name}"),
            F.sum(t * (t - 1) / 2).alias(f"tied_{name}"),
            F.sum(t * (t - 1) * (t - 2)).alias(f"_t0_{name}"),
            F.sum(t * (t - 1) * (2 * t + 5)).alias(f"_t1_{name}"),
            F.sum(t * t).alias(f"_sq_{name}"),
            F.sum(t * t * (2 * t + 3)).alias(f"_cu_{name}"),
        )

    parts = [ties([x], "x"), ties([y], "y"), ties([x, y], "xy")]
    if keys:
        for p in parts:
            conc = conc.join(p, keys)
        out = conc
    else:
        out = conc
        for p in parts:
            out = join_stats(out, p, [])
    n = F.col("_n_x")
    return out.withColumn("n", n.cast("bigint")).withColumn("_pairs", n * (n - 1) / 2)


def kendall(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Tau-b with the asymptotic two-sided p (tie-corrected variance)."""
    c = concordance(df, keys, x, y)
    p, n = F.col("concordant"), F.col("_n_x")
    disc = F.col("_pairs") - F.col("tied_x") - F.col("tied_y") + F.col("tied_xy") - p
    s = p - disc
    m = n * (n - 1)
    var = (
        (m * (2 * n + 5) - F.col("_t1_x") - F.col("_t1_y")) / 18
        + F.try_divide(2 * F.col("tied_x") * F.col("tied_y"), m)
        + F.coalesce(F.try_divide(F.col("_t0_x") * F.col("_t0_y"), 9 * m * (n - 2)), F.lit(0.0))
    )
    c = c.withColumn("_s", s).withColumn("_var", var)
    c = c.withColumn(
        "tau", F.try_divide(F.col("_s"), F.sqrt((F.col("_pairs") - F.col("tied_x")) * (F.col("_pairs") - F.col("tied_y"))))
    ).withColumn("p", 2 * tails.z_tail(F.try_divide(F.abs(F.col("_s")), F.sqrt("_var"))))
    return c.select(*keys, "n", "tau", "p")


def jonckheere(df: DataFrame, keys, level: str, value: str) -> DataFrame:
    """Ordered-alternatives trend test; ties count one half, variance without tie correction."""
    c = concordance(df, keys, level, value)
    n = F.col("_n_x")
    c = c.withColumn("j", F.col("concordant") + (F.col("tied_y") - F.col("tied_xy")) / 2)
    mean = (n * n - F.col("_sq_x")) / 4
    var = (n * n * (2 * n + 3) - F.col("_cu_x")) / 72
    c = c.withColumn("z", F.try_divide(F.col("j") - mean, F.sqrt(var)))
    c = c.withColumn("p_increasing", tails.z_tail("z")).withColumn("p_two_sided", 2 * tails.z_tail(F.abs("z")))
    return c.select(*keys, "n", "j", "z", "p_increasing", "p_two_sided")


def simple_regression(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = both.groupBy(*keys).agg(
        F.count("*").alias("n"),
        X.slope(y, x).alias("slope"),
        X.intercept(y, x).alias("intercept"),
        X.corr(x, y).alias("r"),
    )
    return _r_to_p(g)


def paired_t(df: DataFrame, keys, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    g = df.filter(d.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.var_samp(d).alias("_v")
    )
    g = g.withColumn("t", F.when(F.col("_v") > 0, F.col("mean_diff") / F.sqrt(F.col("_v") / F.col("n"))))
    return g.withColumn("p", tails.two_sided_t(F.col("t"), F.col("n") - 1)).drop("_v")


def two_sample_t(df: DataFrame, keys, group: str, first, second, value: str, welch: bool = False) -> DataFrame:
    """t of ``first`` minus ``second``; pooled variance, or Welch's."""
    g = F.col(group)
    pick = lambda which: F.when(g == F.lit(which), F.col(value))
    s = df.filter(g.isin(first, second) & F.col(value).isNotNull()).groupBy(*keys).agg(
        *[
            f(pick(w)).alias(f"{name}{i}")
            for i, w in ((1, first), (2, second))
            for name, f in (("n", F.count), ("mean", F.avg), ("_v", F.var_samp))
        ]
    )
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "_v1", "_v2"))
    if welch:
        a, b = F.try_divide(v1, n1), F.try_divide(v2, n2)
        se2 = a + b
        dof = F.try_divide(se2 * se2, F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n2 - 1))
    else:
        dof = (n1 + n2 - 2).cast("double")
        se2 = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, dof) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))
    s = s.withColumn("df", dof).withColumn(
        "t", F.when(se2 > 0, (F.col("mean1") - F.col("mean2")) / F.sqrt(se2))
    )
    return s.withColumn("p", tails.two_sided_t(F.col("t"), F.col("df"))).drop("_v1", "_v2")


def group_moments(df: DataFrame, keys, group: str, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, group).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("vp")
    )


def anova(df: DataFrame, keys, group: str, value: str) -> DataFrame:
    """One-way analysis of variance from group counts, means and variances."""
    m = group_moments(df, keys, group, value)
    n, mu = F.col("n"), F.col("mean")
    s = m.groupBy(*keys).agg(
        F.sum("n").alias("n_total"),
        F.count("*").alias("k"),
        (F.sum(n * mu * mu) - F.sum(n * mu) * F.sum(n * mu) / F.sum("n")).alias("ss_between"),
        F.sum(n * F.col("vp")).alias("ss_within"),
    )
    d1, d2 = F.col("k") - 1, F.col("n_total") - F.col("k")
    s = s.withColumn("f", F.try_divide(F.col("ss_between") * d2, F.col("ss_within") * d1))
    return s.withColumn("p", F.when(F.col("f").isNotNull(), tails.f_tail("f", d1.cast("double"), d2.cast("double"))))


def chi_square(df: DataFrame, keys, a: str, b: str, yates: bool = False) -> DataFrame:
    """Chi-square of a contingency table; Yates' correction only for 2x2 tables."""
    keys = list(keys)
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, a, b).agg(F.count("*").alias("o"))
    # The chi-square sum over empty cells adds their expected counts, i.e. n minus the seen ones.
    # Margins are grouped and joined: no window holds a whole margin or table.
    ma = cells.groupBy(*keys, a).agg(F.sum("o").alias("_a"))
    mb = cells.groupBy(*keys, b).agg(F.sum("o").alias("_b"))
    whole = ma.groupBy(*keys).agg(F.sum("_a").alias("_n"), F.count("*").alias("_ra"))
    columns = mb.groupBy(*keys).agg(F.count("*").alias("_rb"))
    c = null_safe_join(null_safe_join(cells, ma, [*keys, a]), mb, [*keys, b])
    c = join_stats(join_stats(c, whole, keys), columns, keys)
    e = F.col("_a") * F.col("_b") / F.col("_n")
    dev = F.abs(F.col("o") - e)
    small = dev - F.least(F.lit(0.5), dev)
    g = c.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        F.max("_ra").alias("_ra"),
        F.max("_rb").alias("_rb"),
        F.sum(dev * dev / e).alias("_x"),
        F.sum(small * small / e).alias("_xy"),
        F.sum(e).alias("_seen"),
        F.count("*").alias("_cells"),
    )
    dof = (F.col("_ra") - 1) * (F.col("_rb") - 1)
    plain = F.col("_x") + (F.col("n") - F.col("_seen"))
    two = (F.col("_ra") == 2) & (F.col("_rb") == 2) & (F.col("_cells") == 4)
    stat = F.when(two, F.col("_xy")).otherwise(plain) if yates else plain
    g = g.withColumn("chi2", stat).withColumn("df", dof)
    return g.withColumn("p", tails.chi2_tail("chi2", F.col("df").cast("double"))).select(*keys, "n", "chi2", "df", "p")


def fisher_exact(df: DataFrame, keys, a: str, b: str) -> DataFrame:
    """Two-sided exact test of two boolean columns."""
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    g = df.filter(x.isNotNull() & y.isNotNull()).groupBy(*keys).agg(
        F.count_if(x & y).alias("n11"),
        F.count_if(x & ~y).alias("n10"),
        F.count_if(~x & y).alias("n01"),
        F.count_if(~x & ~y).alias("n00"),
    )
    odds = F.when(F.col("n10") * F.col("n01") > 0, F.col("n11") * F.col("n00") / (F.col("n10") * F.col("n01")))
    return g.withColumn("odds", odds).withColumn("p", tails.fisher_p("n11", "n10", "n01", "n00"))


def sign_test(df: DataFrame, keys, value: str, alternative: str = "two-sided") -> DataFrame:
    v = F.col(value)
    g = df.groupBy(*keys).agg(F.count_if(v > 0).alias("n_pos"), F.count_if(v < 0).alias("n_neg"))
    n = (F.col("n_pos") + F.col("n_neg")).cast("double")
    k, q = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    p = {"greater": tails.binomial_upper(k, n), "less": tails.binomial_upper(q, n)}.get(
        alternative, tails.binomial_p(k, n)
    )
    return g.withColumn("p", p)


def wilcoxon(df: DataFrame, keys, value: str, alternative: str = "two-sided") -> DataFrame:
    """Signed-rank test; zeros are dropped."""
    keys = list(keys)
    d = df.filter(F.col(value) != 0).select(*keys, F.abs(value).alias("_abs"), (F.col(value) > 0).alias("_pos"))
    t = running_totals(d, keys, "_abs", {"_c": F.lit(1).cast("bigint"), "_up": F.col("_pos").cast("bigint")})
    rank = F.col("below__c") + (F.col("_c") + 1) / 2
    c = F.col("_c").cast("double")
    g = t.groupBy(*keys).agg(
        F.sum("_c").alias("n"),
        F.sum(F.col("_up") * rank).alias("w_plus"),
        F.max(F.col("_c") > 1).alias("_ties"),
        F.sum(c * c * c - c).alias("_tsum"),
    )
    p = tails.wilcoxon_tail(alternative)("w_plus", "n", "_ties", "_tsum")
    return g.withColumn("p", p).drop("_ties", "_tsum")


def bonferroni(df: DataFrame, family, p: str, out: str = "p_adj") -> DataFrame:
    m = df.groupBy(*family).agg(F.count(p).alias("_m"))
    j = join_stats(df, m, family, "left")
    return j.withColumn(out, F.least(F.col(p) * F.col("_m"), F.lit(1.0))).drop("_m")


def bh(df: DataFrame, family, p: str, out: str = "p_adj", small_family: bool = False) -> DataFrame:
    """Benjamini-Hochberg adjusted p within each family; NULL p stays out of the family.

    ``small_family`` is for families whose size the analysis fixes (components, parcels of an
    atlas, items of a questionnaire): one window per family. Without it a family of any size is
    spread over ordered buckets.
    """
    # Running minima go down from the largest p: frames that grow cost one step per row.
    family = list(family)
    if small_family:
        part = Window.partitionBy(*_by(family))
        m = F.count(p).over(part)
        rank = F.count(p).over(part.orderBy(F.col(p).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0))
        raw = df.withColumn("_raw", F.when(F.col(p).isNotNull(), F.col(p) * m / rank))
        tail = part.orderBy(F.col(p).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
        adj = F.when(F.col(p).isNotNull(), F.least(F.min("_raw").over(tail), F.lit(1.0)))
        return raw.withColumn(out, adj).drop("_raw")
    t = running_totals(df, family, p, {"_c": F.lit(1).cast("bigint")})
    t = t.withColumn("_raw", F.col(p) * F.col("all__c") / (F.col("below__c") + F.col("_c")))
    inside = Window.partitionBy(*family, "_bucket").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*_by(family)).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = t.groupBy(*family, "_bucket").agg(F.min("_raw").alias("_low"))
    later = later.select(*family, "_bucket", F.min("_low").over(after).alias("_later"))
    adj = null_safe_join(t.withColumn("_here", F.min("_raw").over(inside)), later, [*family, "_bucket"])
    adj = adj.select(*family, p, F.least("_here", "_later", F.lit(1.0)).alias(out))
    return null_safe_join(df, adj, [*family, p], "left")
