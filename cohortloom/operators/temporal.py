"""Time-series operators. Time is an integer index; lags move rows to later indices and are then
grouped by (key, time), so no whole series is ever sorted in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.scalar import col, key_hash
from cohortloom.operators.ordering import null_safe_join, rank_table

# Delays in samples, and the first points of the chunks into which the published analysis cuts 740 points.
DELAYS = (3, 5, 7, 9)
STARTS_9 = (0, 82, 164, 247, 329, 411, 494, 576, 658)
STARTS_16 = (0, 46, 92, 138, 185, 231, 277, 323, 370, 416, 462, 508, 555, 601, 647, 693)


def join_stats(df: DataFrame, stats: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Attach one statistics row per key. Spark broadcasts the small side when its measured size
    allows, and splits skewed keys of the large side otherwise. Without keys ``stats`` is a single
    row, read as a scalar subquery."""
    keys = list(keys)
    if keys:
        return null_safe_join(df, stats, keys, how)
    row = stats.select(F.struct(*stats.columns).alias("_row")).scalar()
    return df.select("*", row.alias("_row")).select("*", "_row.*").drop("_row")


def lag_features(df: DataFrame, keys, t: str, value: str, delays=DELAYS) -> DataFrame:
    """One column per delay with the value ``delay`` points earlier; 0 before the start."""
    keys = list(keys)
    steps = F.array(*[F.lit(d) for d in (0, *delays)])
    moved = df.select(*keys, F.col(t).alias("_t"), F.col(value).alias("_v")).withColumn("_d", F.explode(steps))
    g = moved.groupBy(*keys, (F.col("_t") + F.col("_d")).alias(t)).agg(
        F.max(F.when(F.col("_d") == 0, 1)).alias("_here"),
        F.max(F.when(F.col("_d") == 0, F.col("_v"))).alias(value),
        *[F.coalesce(F.max(F.when(F.col("_d") == d, F.col("_v"))), F.lit(0.0)).alias(f"{value}_lag{d}") for d in delays],
    )
    return g.filter("_here = 1").drop("_here")


def trim(df: DataFrame, keys, t: str, start: int, end: int) -> DataFrame:
    """Drop the first ``start`` and last ``end`` time points of every series."""
    b = df.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    j = join_stats(df, b, keys)
    return j.filter((F.col(t) >= F.col("_lo") + start) & (F.col(t) <= F.col("_hi") - end)).drop("_lo", "_hi")


def chunk_starts(n_points: int, chunks: int | Sequence[int]) -> list[int]:
    """First point of every contiguous chunk: those given, or a number of near-equal ones."""
    if isinstance(chunks, int):
        return [-(-c * n_points // chunks) for c in range(chunks)]
    return list(chunks)


def fold_count(chunks: int | Sequence[int]) -> int:
    """Folds of a chunk layout: the square root of its number of chunks."""
    return math.isqrt(chunks if isinstance(chunks, int) else len(chunks))


def chunk_of(t, n_points: int, n_chunks: int | Sequence[int]) -> Column:
    starts = chunk_starts(n_points, n_chunks)[1:]
    return sum((F.when(col(t) >= s, 1).otherwise(0) for s in starts), F.lit(0)).cast("int")


def assign_folds(df: DataFrame, t: str, n_points: int, n_chunks: int | Sequence[int]) -> DataFrame:
    """Contiguous chunks; fold = chunk modulo the square root of their number. ``n_chunks`` may be the chunks' first points.

    ``pos`` is the position of the point inside its fold.
    """
    side = fold_count(n_chunks)
    starts = [*chunk_starts(n_points, n_chunks), n_points]
    shift = []
    for c in range(len(starts) - 1):
        earlier = sum(starts[e + 1] - starts[e] for e in range(c % side, c, side))
        shift.append(earlier - starts[c])
    out = df.withColumn("chunk", chunk_of(t, n_points, n_chunks))
    move = F.element_at(F.array(*[F.lit(s) for s in shift]), F.col("chunk") + 1)
    return out.withColumn("fold", F.col("chunk") % side).withColumn("pos", (F.col(t) + move).cast("int"))


def ab_split(df: DataFrame, pos: str, length: int, n: Column | None = None) -> DataFrame:
    """Alternating blocks A and B; odd/even points if the series fills only one block."""
    block = (F.floor(F.col(pos) / length) % 2).cast("int")
    if n is not None:
        block = F.when(n <= length, (F.col(pos) % 2).cast("int")).otherwise(block)
    return df.withColumn("half", block)


def block_holdout(blocks: DataFrame, keys, block: str, n_boot: int, frac: int, seed: int, small: bool = False) -> DataFrame:
    """Held-out blocks per bootstrap: the ``floor(n / frac)`` blocks of lowest hash.

    ``blocks`` holds one row per (keys, block), not the time points. ``small`` is for block lists
    that a fixed time grid bounds: one window per bootstrap instead of bucketed ranks.
    """
    keys = list(keys)
    b = blocks.select(*keys, block).distinct().withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    # The block number breaks ties of the hash, so every value is distinct.
    b = b.withColumn("_h", F.shiftright(key_hash(block, "boot", seed), 24) * 1000003 + F.col(block))
    if small:
        part = Window.partitionBy(*keys, "boot")
        b = b.withColumn("_r", F.row_number().over(part.orderBy("_h"))).withColumn("_n", F.count("*").over(part))
        return b.filter(F.col("_r") <= F.floor(F.col("_n") / frac)).drop("_h", "_r", "_n")
    r = rank_table(b, [*keys, "boot"], "_h")
    held = r.filter(F.col("_below") < F.floor(F.col("_total") / frac)).select(*keys, "boot", "_h")
    return b.join(held, [*keys, "boot", "_h"], "left_semi").drop("_h")


def zscore(df: DataFrame, keys, value: str, ddof: int = 0, out: str = "z") -> DataFrame:
    """z-score per key; NULL where the deviation is 0."""
    sd = F.stddev_samp if ddof else F.stddev_pop
    s = df.groupBy(*keys).agg(F.avg(value).alias("_m"), sd(value).alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))
    return join_stats(df, s, keys).withColumn(out, z).drop("_m", "_s")


def minmax_bias(df: DataFrame, keys, value: str, bias: float, out: str = "scaled") -> DataFrame:
    """Scale to [0, 1 - bias] per key, then add ``bias`` times the original."""
    s = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    unit = F.when(span > 0, (F.col(value) - F.col("_lo")) / span).otherwise(0.0)
    return join_stats(df, s, keys).withColumn(out, unit * (1 - bias) + bias * F.col(value)).drop("_lo", "_hi")


def linear_trend(t, n) -> Column:
    """Trend from -1 to 1 over ``n`` points."""
    return 2 * col(t) / (col(n) - 1) - 1
