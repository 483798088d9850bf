"""Cohort selection, score joins, frequency tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalar import number


@dataclass(frozen=True)
class QcRules:
    """Quality rules over configurable columns. A NULL never passes a rule, and a missing
    document counts as "not provided"."""

    group: str
    groups: tuple
    certainty: str
    uncertain: str
    document: str
    documented: str
    equal: dict = field(default_factory=dict)
    below: dict = field(default_factory=dict)

    def conditions(self) -> dict[str, Column]:
        out = {
            "group": F.col(self.group).isin(*self.groups),
            "history": ~(
                F.col(self.certainty).eqNullSafe(self.uncertain)
                & ~F.col(self.document).eqNullSafe(self.documented)
            ),
        }
        for c, v in self.equal.items():
            out[c] = F.col(c).eqNullSafe(v)
        for c, v in self.below.items():
            out[c] = F.coalesce(F.col(c) < v, F.lit(False))
        return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


def qc_cohort(participants: DataFrame, rules: QcRules) -> DataFrame:
    return participants.filter(reduce(lambda a, b: a & b, rules.conditions().values()))


def qc_audit(participants: DataFrame, rules: QcRules) -> DataFrame:
    """Rows rejected by each rule, taken alone, and rows kept by all."""
    conds = rules.conditions()
    kept = reduce(lambda a, b: a & b, conds.values())
    return participants.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(~c).alias(f"rejected_{name}") for name, c in conds.items()],
        F.count_if(kept).alias("kept"),
    )


def cohort_intersect(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_semi")


def complete_cases(df: DataFrame, cols) -> DataFrame:
    """Rows where every listed column holds a number."""
    ok = reduce(lambda a, b: a & b, [number(F.col(c).cast("string")).isNotNull() for c in cols])
    return df.filter(ok)


def reject_text(df: DataFrame, cols) -> DataFrame:
    """Drop rows where a listed column holds text that is no number; missing values stay."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & number(c).isNull() for c in cols])
    return df.filter(~bad)


def screen_bands(df: DataFrame, band: str, group: str, groups, min_n: int) -> DataFrame:
    """Drop every band with fewer than ``min_n`` members in any of the groups."""
    counts = df.groupBy(band).agg(
        *[F.count_if(F.col(group) == F.lit(g)).alias(f"n{i}") for i, g in enumerate(groups)]
    )
    sparse = reduce(lambda a, b: a | b, [F.col(f"n{i}") < min_n for i in range(len(groups))])
    return df.join(counts.filter(sparse).select(band), band, "left_anti")


def attach_scores(df: DataFrame, scores: DataFrame, subject: str, key: str, items, order: str, prefix: str = "sub-", suffix: str = ",assessment") -> DataFrame:
    """Left join of questionnaire items on the rewritten key; first row on duplicates, numbers only."""
    first = scores.groupBy(key).agg(F.min_by(F.struct(*items), order).alias("_s"))
    first = first.select(key, *[number(F.col(f"_s.{i}")).alias(i) for i in items])
    rewritten = F.concat(F.regexp_replace(F.col(subject), f"^{prefix}", ""), F.lit(suffix))
    return df.withColumn("_key", rewritten).join(first.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")


def attach_clusters(df: DataFrame, labels: DataFrame, subject: str, group: str, control, label: str, constant: str = "control") -> DataFrame:
    """Controls get a constant, cases their cluster, cases without one ``unassigned``."""
    j = df.join(labels.select(subject, F.col(label).cast("string").alias("_c")), subject, "left")
    return j.withColumn(
        "cluster",
        F.when(F.col(group) == F.lit(control), constant).otherwise(F.coalesce("_c", F.lit("unassigned"))),
    ).drop("_c")


def key_audit(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one table that the other lacks."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("status", F.lit("missing")).unionByName(
        right.join(left, key, "left_anti").withColumn("status", F.lit("unused"))
    )


def value_counts(df: DataFrame, cols) -> DataFrame:
    """Frequency of every value of every listed column, in one pass."""
    long = df.unpivot([], [F.col(c).cast("string").alias(c) for c in cols], "variable", "level")
    return long.groupBy("variable", "level").agg(F.count("*").alias("n"))


def shared_control_union(df: DataFrame, subset: str, is_control: Column, subsets) -> DataFrame:
    """One table per subset, each with all controls: rows tagged with ``subset_id``.

    The subsets are a short fixed list, so a control row is repeated once per subset.
    """
    ids = F.array(*[F.lit(s) for s in subsets])
    tags = F.when(is_control, ids).otherwise(F.array(F.col(subset)))
    return df.withColumn("subset_id", F.explode(tags)).filter(F.col("subset_id").isin(*subsets))


def subset_summary(df: DataFrame, subset: str, group: str, groups, cols) -> DataFrame:
    """Size, size per group, mean and sample sd per column, and mean of row means, per subset."""
    rows = reduce(lambda a, b: a + b, [F.col(c) for c in cols]) / len(cols)
    return df.groupBy(subset).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(group) == F.lit(g)).alias(f"n_{i}") for i, g in enumerate(groups)],
        *[f(c).alias(f"{name}_{c}") for c in cols for name, f in (("mean", F.avg), ("sd", F.stddev_samp))],
        F.avg(rows).alias("mean_of_row_means"),
    )


def group_mean(df: DataFrame, keys, value: str, out: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(out))


def crosstab(df: DataFrame, a: str, b: str, levels) -> DataFrame:
    return df.groupBy(a).agg(*[F.count_if(F.col(b) == F.lit(v)).alias(f"n_{v}") for v in levels])


def outlier_prevalence(df: DataFrame, cols, threshold: float, keys=()) -> DataFrame:
    """Share of ``abs(z) > threshold`` per variable."""
    long = df.unpivot(list(keys), list(cols), "variable", "z")
    return long.groupBy(*keys, "variable").agg(
        F.count("z").alias("n"), F.avg((F.abs("z") > threshold).cast("double")).alias("prevalence")
    )


def band(c: str, edges) -> Column:
    """Half-open bands ``(lo, hi]`` over ``edges``, the lowest edge included in the first."""
    v = F.col(c)
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = ((v >= lo) if i == 0 else (v > lo)) & (F.lit(True) if hi is None else v <= hi)
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def outlier_prevalence_by_band(df: DataFrame, cols, threshold: float, by: str, edges) -> DataFrame:
    """Outlier share per band; an empty band reports 0."""
    g = outlier_prevalence(df.withColumn("band", band(by, edges)).filter("band is not null"), cols, threshold, ["band"])
    spark = df.sparkSession
    grid = spark.range(len(edges) - 1).select(
        F.col("id").cast("int").alias("band"), F.explode(F.array(*[F.lit(c) for c in cols])).alias("variable")
    )
    return grid.join(g, ["band", "variable"], "left").fillna(0, ["n"]).fillna(0.0, ["prevalence"])


def category_prevalence(df: DataFrame, categories: dict[str, Column], keys) -> DataFrame:
    """Prevalence of any-of flags per key. A flag is an OR over its diagnosis columns."""
    flags = [c.cast("int").alias(n) for n, c in categories.items()]
    long = df.select(*keys, *flags).unpivot(list(keys), list(categories), "category", "flag")
    return long.groupBy(*keys, "category").agg(
        F.count("flag").alias("n"), F.sum("flag").alias("n_flag"), F.avg("flag").alias("prevalence")
    )


def any_of(cols) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == 1, F.lit(False)) for c in cols])
