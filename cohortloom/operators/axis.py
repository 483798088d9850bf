"""Delay pooling, principal axes and the alignment of subjects to a template."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from cohortloom.functions.scalar import corr
from cohortloom.functions.small import centred, symmetric_eigen, unpack
from cohortloom.operators.atlas import rollup
from cohortloom.operators.gram import check_width, key_fields, map_rows, moments_wide
from cohortloom.operators.stats import _r_to_p, bh
from cohortloom.operators.temporal import join_stats
from cohortloom.session import cut


def collapse_delays(w: DataFrame, keys, delay: str, value: str, how: str) -> DataFrame:
    """Mean over delays, or the value of largest magnitude (first delay on ties)."""
    if how == "mean":
        return w.groupBy(*keys).agg(F.avg(value).alias(value))
    if how == "max":
        return w.groupBy(*keys).agg(F.max_by(value, F.struct(F.abs(value), -F.col(delay))).alias(value))
    raise ValueError("how is 'mean' or 'max'")


def pack_rows(df: DataFrame, keys, feature: str, value: str, vocab, out: str = "vec") -> DataFrame:
    """One array per key in vocabulary order; absent features are 0. The vocabulary is fixed."""
    check_width(len(vocab))
    place = F.array_position(F.array(*[F.lit(v) for v in vocab]), F.col(feature)) - 1
    d = df.select(*keys, place.cast("int").alias("_i"), F.col(value).cast("double").alias("_v")).filter("_i >= 0")
    g = d.groupBy(*keys).agg(F.collect_list(F.struct("_i", "_v")).alias("_e"))
    return g.select(*keys, dense("_e", len(vocab)).alias(out))


def dense(entries: str, width: int) -> Column:
    """Array of ``width`` values from (position, value) entries; absent positions are 0.

    Complete rows only need sorting; the lookup is for rows with gaps. A repeated position is an error that says so.
    """
    places = F.transform(entries, lambda e: e["_i"])
    repeated = F.size(F.array_distinct(places)) < F.size(places)
    ordered = F.transform(F.array_sort(entries), lambda e: e["_v"])
    m = F.map_from_entries(entries)
    gaps = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))
    complete = F.transform(F.array_sort(entries), lambda e: e["_i"].cast("int")) == F.sequence(F.lit(0), F.lit(width - 1))
    twice = F.raise_error(F.lit("a position of a packed row has two values; aggregate them first")).cast("array<double>")
    return F.when(complete, ordered).when(repeated, twice).otherwise(gaps)


def dot(a, b) -> Column:
    """Dot product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def eigen_table(grams: DataFrame, keys, k: int, scale: str = "cov") -> DataFrame:
    """Leading components per key: eigenvalue, share of variance, loadings, column means."""
    schema = StructType(
        [
            *key_fields(grams, keys),
            StructField("comp", IntegerType()),
            StructField("n", LongType()),
            StructField("eigenvalue", DoubleType()),
            StructField("ratio", DoubleType()),
            StructField("loading", ArrayType(DoubleType())),
            StructField("mean", ArrayType(DoubleType())),
        ]
    )
    keys = list(keys)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, s = centred(unpack(np.vstack(pdf["_gram"].to_numpy())))
        mean = np.vstack(pdf["_mean"].to_numpy()) if "_mean" in pdf else mean
        w, v = symmetric_eigen(s / (n - 1)[:, None, None])
        total = np.maximum(np.trace(s, axis1=1, axis2=2) / (n - 1), 1e-300)
        top = min(k, w.shape[1])
        row = np.repeat(np.arange(len(pdf)), top)
        c = np.tile(np.arange(top), len(pdf))
        out = pdf[keys].iloc[row].reset_index(drop=True)
        out["comp"] = (c + 1).astype("int32")
        out["n"] = n[row].astype("int64")
        out["eigenvalue"] = w[row, c]
        out["ratio"] = w[row, c] / total[row]
        out["loading"] = list(v[row, :, c])
        out["mean"] = list(mean[row])
        return out

    return map_rows(grams, keys, step, schema)


def pca(df: DataFrame, keys, vec: str, width: int, k: int) -> DataFrame:
    """Centred principal components per key of the rows' array column."""
    check_width(width)
    return eigen_table(moments_wide(df, keys, vec, width), keys, k)


def pca_scores(df: DataFrame, components: DataFrame, keys, row, vec: str) -> DataFrame:
    """Scores of every row on every component: ``(keys, row, comp, score)``."""
    c = components.select(*keys, "comp", "loading", dot(F.col("mean"), F.col("loading")).alias("_m"))
    packed = c.groupBy(*keys).agg(F.collect_list(F.struct("comp", "loading", "_m")).alias("_c"))
    j = join_stats(df.select(*keys, *row, vec), packed, keys).withColumn("_k", F.explode("_c"))
    return j.select(*keys, *row, F.col("_k.comp").alias("comp"), (dot(F.col(vec).cast("array<double>"), F.col("_k.loading")) - F.col("_k._m")).alias("score"))


def anchor_sign(scores: DataFrame, atlas: DataFrame, parcel: str, section: str, anchor, comp: int = 1) -> DataFrame:
    """Flip component ``comp`` if the anchor section's mean is negative; a section without parcels flips nothing."""
    s = scores.filter(F.col("comp") == comp)
    mean = rollup(s, atlas, parcel, section, "score", "masked").filter(F.col(section) == F.lit(anchor))
    flip = mean.agg(F.when(F.max("value") < 0, -1.0).otherwise(1.0).alias("_f"))  # one row, also of none
    j = join_stats(scores, flip, [])
    return j.withColumn("score", F.when(F.col("comp") == comp, F.col("score") * F.col("_f")).otherwise(F.col("score"))).drop("_f")


def align_sign(scores: DataFrame, reference: DataFrame, subject: str, parcel: str, n_iter: int = 10, tol: float = 1e-5, alpha: float = 0.01) -> DataFrame:
    """Signs per (subject, component) that align subject scores to a moving reference.

    A component is flipped iff its correlation with the reference is negative and significant after
    Benjamini-Hochberg over the components. The state of the loop is the sign table and the
    reference map; the scores are read once per round and never rewritten.
    """
    ref, last = reference.select(parcel, "comp", F.col("score").alias("_ref")), None
    signs = None
    for _ in range(n_iter):
        j = scores.join(ref, [parcel, "comp"])
        r = j.groupBy(subject, "comp").agg(F.count("*").alias("n"), corr("score", "_ref").alias("r"))
        r = bh(_r_to_p(r), [subject], "p", "q", small_family=True)
        flip = (F.col("r") < 0) & (F.col("q") < alpha)
        signs = r.select(subject, "comp", F.when(flip, -1.0).otherwise(1.0).alias("sign"))
        new = scores.join(signs, [subject, "comp"]).groupBy(parcel, "comp").agg(F.avg(F.col("score") * F.col("sign")).alias("_new"))
        new = cut(new)
        step = new.join(ref, [parcel, "comp"]).agg(F.sum(F.pow(F.col("_ref") - F.col("_new"), 2))).first()[0]
        ref = new.withColumnRenamed("_new", "_ref")
        if last is not None and abs(step - last) < tol:
            break
        last = step
    return signs


def apply_signs(scores: DataFrame, signs: DataFrame, subject: str) -> DataFrame:
    return scores.join(signs, [subject, "comp"]).withColumn("score", F.col("score") * F.col("sign")).drop("sign")


def procrustes_rotation(scores: DataFrame, reference: DataFrame, subject: str, parcel: str, k: int) -> DataFrame:
    """Orthogonal rotation per subject onto the reference; inputs hold a ``vec`` of k scores."""
    j = scores.select(subject, parcel, F.col("vec").alias("_s")).join(reference.select(parcel, F.col("vec").alias("_r")), parcel)
    sums = [F.sum(F.col("_s")[a] * F.col("_r")[b]).alias(f"_{a}_{b}") for a in range(k) for b in range(k)]
    g = j.groupBy(subject).agg(*sums)
    g = g.select(subject, F.array(*[f"_{a}_{b}" for a in range(k) for b in range(k)]).alias("m"))

    @F.pandas_udf(ArrayType(DoubleType()))
    def rotate(m: pd.Series) -> pd.Series:
        u, _, vt = np.linalg.svd(np.vstack(m.to_numpy()).reshape(-1, k, k))
        return pd.Series(list((u @ vt).reshape(-1, k * k)))

    return g.select(subject, rotate("m").alias("rotation"))


def align_procrustes(scores: DataFrame, reference: DataFrame, subject: str, parcel: str, k: int, n_iter: int = 10, tol: float = 1e-5) -> DataFrame:
    """Generalised Procrustes: rotations per subject (row-major k x k)."""
    ref, last, rot = reference.select(parcel, "vec"), None, None
    turned = F.array(*[sum((F.col("vec")[a] * F.col("rotation")[a * k + b] for a in range(k)), F.lit(0.0)) for b in range(k)])
    for _ in range(n_iter):
        rot = procrustes_rotation(scores, ref, subject, parcel, k)
        al = scores.join(rot, subject).select(parcel, turned.alias("v"))
        new = cut(al.groupBy(parcel).agg(F.array(*[F.avg(F.col("v")[b]) for b in range(k)]).alias("vec")))
        d = F.aggregate(F.zip_with("vec", "_o", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
        step = new.join(ref.withColumnRenamed("vec", "_o"), parcel).agg(F.sum(d)).first()[0]
        ref = new
        if last is not None and abs(step - last) < tol:
            break
        last = step
    return rot


def explained_variance(df: DataFrame, keys, vec: str, width: int, k: int) -> DataFrame:
    return pca(df, keys, vec, width, k).select(*keys, "comp", "ratio")
