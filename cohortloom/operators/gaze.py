"""Gaze-weighted label presence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalar import clip, gaussian_weight, gaze_x, gaze_y
from cohortloom.operators.ordering import percentiles
from cohortloom.operators.temporal import join_stats


def gaze_per_frame(samples: DataFrame, keys) -> DataFrame:
    """Median over the samples of a frame. ``keys`` identify one frame of one run, and a frame
    holds a fixed handful of samples."""
    return samples.groupBy(*keys).agg(*[F.median(c).alias(c) for c in ("gx", "gy", "unc")])


def to_screen(gaze: DataFrame, screen: DataFrame, on) -> DataFrame:
    """Degrees to screen coordinates with the site and movie scale."""
    j = gaze.join(screen, on)
    return j.withColumn("gx", gaze_x("gx", "sx")).withColumn("gy", gaze_y("gy", "sy")).drop("sx", "sy")


def clip_uncertainty(gaze: DataFrame, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Clip the uncertainty to its pooled percentiles."""
    b = percentiles(gaze, [], "unc", {"_lo": low, "_hi": high})
    return join_stats(gaze, b, []).withColumn("unc", clip("unc", F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def gaze_weighted_presence(gaze: DataFrame, mask_px: DataFrame, frame: str, subject: str, labels, factor: float, radius: int) -> DataFrame:
    """Mean gaze weight over the pixels of each label, per subject and frame; absent label gives 0.

    The weight is evaluated at labelled pixels only, so no per-frame map is ever stored.
    """
    g = gaze.withColumn("label", F.explode(F.array(*[F.lit(v) for v in labels])))
    # A frame repeats few distinct pixels, so equal ones are counted before the join.
    px = mask_px.groupBy(frame, "label", "px", "py").agg(F.count("*").alias("_c"))
    j = g.join(px, [frame, "label"], "left")
    w = gaussian_weight(F.col("px") - F.col("gx"), F.col("py") - F.col("gy"), F.col("unc") * factor, radius)
    out = j.withColumn("_w", F.when(F.col("px").isNotNull(), w))
    return out.groupBy(subject, frame, "label").agg(
        F.coalesce(F.try_divide(F.sum(F.col("_w") * F.col("_c")), F.sum(F.when(F.col("px").isNotNull(), F.col("_c")))), F.lit(0.0)).alias("weight")
    )

