"""Label hierarchies: ancestor closure, expansion, merging, label graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.temporal import join_stats
from cohortloom.session import cut


def ancestors(hier: DataFrame, child: str = "child", parent: str = "parent", max_rounds: int = 12) -> DataFrame:
    """Closure ``(node, ancestor, depth)`` of a one-parent hierarchy.

    Path doubling: after round r all ancestors up to ``2^r`` steps are known, so a tree of depth
    d takes log2(d) joins. Every round is checkpointed.
    """
    known = hier.filter(F.col(parent).isNotNull() & (F.col(parent) != F.col(child))).select(
        F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")
    )
    hop, reach = known, 1
    for _ in range(max_rounds):
        step = hop.select(F.col("node").alias("_mid"), F.col("ancestor").alias("_top"))
        new = cut(
            known.join(step, known["ancestor"] == step["_mid"]).select(
                "node", F.col("_top").alias("ancestor"), (F.col("depth") + reach).alias("depth")
            )
        )
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        reach *= 2
        hop = new.filter(F.col("depth") == reach)
    raise ValueError("hierarchy deeper than the limit, or cyclic")


def expand_hierarchy(reg: DataFrame, closure: DataFrame, feature: str) -> DataFrame:
    """Every label's rows, plus a copy of them under each ancestor (``is_copy``)."""
    up = closure.select(F.col("node").alias(feature), F.col("ancestor").alias("_a"))
    copies = reg.join(up, feature).withColumn(feature, F.col("_a")).drop("_a")
    return reg.withColumn("is_copy", F.lit(False)).unionByName(copies.withColumn("is_copy", F.lit(True)))


def merge_parents(expanded: DataFrame, keys, feature: str, value: str) -> DataFrame:
    """One row per (keys, label): labels with more than one copy become the mean of their non-zero
    values (0 if all are zero); other original labels stay; other copies drop out.

    How often a label was copied does not depend on the keys, so it is counted per key row.
    """
    v = F.col(value)
    g = expanded.groupBy(*keys, feature).agg(
        F.count_if("is_copy").alias("_copies"),
        F.coalesce(F.avg(F.when(v != 0, v)), F.lit(0.0)).alias("_merged"),
        F.max(F.when(~F.col("is_copy"), v)).alias("_own"),
    )
    g = g.filter((F.col("_copies") > 1) | F.col("_own").isNotNull())
    return g.select(*keys, feature, F.when(F.col("_copies") > 1, F.col("_merged")).otherwise(F.col("_own")).alias(value))


def prune(reg: DataFrame, vocab: DataFrame, feature: str) -> DataFrame:
    return reg.join(vocab.select(feature), feature, "left_semi")


def vocabulary_closure(closure: DataFrame, vocab: DataFrame, feature: str) -> DataFrame:
    v = vocab.select(feature).distinct()
    c = closure.join(v.withColumnRenamed(feature, "node"), "node", "left_semi")
    return c.join(v.withColumnRenamed(feature, "ancestor"), "ancestor", "left_semi")


def add_ancestors(w: DataFrame, closure: DataFrame, vocab: DataFrame, keys, feature: str, value: str) -> DataFrame:
    """Each label's weight plus the original weights of its ancestors within the vocabulary."""
    up = vocabulary_closure(closure, vocab, feature)
    down = up.select(F.col("ancestor").alias(feature), F.col("node").alias("_n"))
    gifts = w.join(down, feature).select(*keys, F.col("_n").alias(feature), value)
    own = w.select(*keys, feature, value, F.lit(1).alias("_own"))
    both = own.unionByName(gifts.withColumn("_own", F.lit(0)))
    g = both.groupBy(*keys, feature).agg(F.sum(value).alias(value), F.max("_own").alias("_own"))
    return g.filter("_own = 1").drop("_own")


def label_edges(closure: DataFrame, vocab: DataFrame, feature: str, with_roots: bool = False) -> DataFrame:
    """Edge from each label to its nearest ancestor in the label set.

    Labels without any ancestor are no nodes unless ``with_roots``.
    """
    c = vocabulary_closure(closure, vocab, feature)
    if not with_roots:
        inner = closure.select(F.col("node").alias("ancestor")).distinct()
        c = c.join(inner, "ancestor", "left_semi")
    return c.groupBy("node").agg(F.min_by("ancestor", "depth").alias("ancestor"), F.min("depth").alias("steps"))


def regress_frequency(w: DataFrame, freq: DataFrame, keys, feature: str, value: str, frequency: str) -> DataFrame:
    """Residual of the weights on label frequency, without intercept, per key."""
    j = w.join(freq.select(feature, frequency), feature)
    f = F.col(frequency).cast("double")
    s = j.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(f * F.col(value)), F.sum(f * f)), F.lit(0.0)).alias("_b"))
    return join_stats(j, s, keys).withColumn(value, F.col(value) - f * F.col("_b")).drop("_b", frequency)


def weight_labels(reg: DataFrame, feature: str, mask_value: str, value: str, verb_weight: float) -> DataFrame:
    """Nouns (label with ``_``) take the mask-based value, verbs the weighted regressor."""
    noun = F.col(feature).contains("_")
    return reg.withColumn("weighted", F.when(noun, F.coalesce(F.col(mask_value), F.lit(0.0))).otherwise(verb_weight * F.col(value)))


def append_covariate(x: Column, *covariates: Column) -> Column:
    """Feature vector followed by covariates; scoring later uses the leading features only."""
    return F.concat(x, F.array(*[c.cast("double") for c in covariates]))
