"""Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gaze calibration.
GAZE_SCALE = 10.0
GAZE_Y_FACTOR = 1.2925

# Age bands (upper bounds included).
AGE_BANDS = [
    (10, "childhood"),
    (14, "early_adolescence"),
    (18, "middle_adolescence"),
    (None, "late_adolescence"),
]



def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """NULL instead of NaN or infinity."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def gaze_x(c, scale) -> Column:
    return col(c) / GAZE_SCALE * col(scale)


def gaze_y(c, scale) -> Column:
    return col(c) / GAZE_SCALE * GAZE_Y_FACTOR * -1 * col(scale)


def gaussian_weight(dx, dy, sigma, radius: int) -> Column:
    """2-D Gaussian with circular support, scaled so that its separable kernel sums to one.

    The kernel has ``2 * radius + 1`` taps per axis, so each axis is divided by the sum
    of ``exp(-i*i / 2s^2)`` over ``i = -radius..radius``.
    """
    dx, dy, s = col(dx).cast("double"), col(dy).cast("double"), col(sigma).cast("double")
    two = 2 * s * s
    axis = F.aggregate(
        F.sequence(F.lit(-radius), F.lit(radius)),
        F.lit(0.0),
        lambda acc, i: acc + F.exp(-(i * i) / two),
    )
    d2 = dx * dx + dy * dy
    return F.when(d2 <= radius * radius, F.exp(-d2 / two) / (axis * axis)).otherwise(0.0)


def safe_divide(a, b) -> Column:
    """``a / b``, 0 where the denominator is not positive."""
    return F.when(col(b) > 0, col(a) / col(b)).otherwise(0.0)


def clip(c, lo, hi) -> Column:
    """Clip to bounds, keeping NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, hi), lo))


def spearman_brown(r) -> Column:
    """Reliability of the full set from a half-half correlation, as a ceiling in [0, 1]."""
    r = col(r)
    return F.sqrt(clip(2 * r / (1 + r + 1e-12), F.lit(0.0), F.lit(1.0)))


def fisher_z(r, diagonal=None) -> Column:
    """``atanh`` of a correlation; where ``diagonal`` holds the value is 0."""
    z = F.atanh(col(r))
    return z if diagonal is None else F.when(diagonal, 0.0).otherwise(z)


def similarity_to_distance(s, lo, hi, diagonal) -> Column:
    """``1 - minmax(s)`` with a zero diagonal; a constant input keeps its values."""
    s, lo, hi = col(s), col(lo), col(hi)
    scaled = F.when(hi > lo, (s - lo) / (hi - lo)).otherwise(s)
    return F.when(diagonal, 0.0).otherwise(1 - scaled)


def directional_p(p, stat, alternative: str) -> Column:
    """One-sided p from a two-sided p and the sign of the statistic."""
    p, stat = col(p), col(stat)
    if alternative == "greater":
        return F.when(stat > 0, p / 2).otherwise(1 - p / 2)
    if alternative == "less":
        return F.when(stat < 0, p / 2).otherwise(1 - p / 2)
    if alternative == "two-sided":
        return p
    raise ValueError(f"unknown alternative {alternative!r}")


def age_band(age) -> Column:
    age = col(age)
    out = None
    for upper, name in AGE_BANDS:
        if upper is not None:
            out = F.when(age <= upper, name) if out is None else out.when(age <= upper, name)
        else:
            out = out.when(age.isNotNull(), name)
    return out


def dummy(c, value) -> Column:
    """1 where the category equals ``value``, 0 elsewhere, NULL stays."""
    return (col(c) == F.lit(value)).cast("int")


def metric_average(a, b) -> Column:
    """Average of two metrics, the first with its sign turned."""
    return (-col(a) + col(b)) / 2


def stars(p) -> Column:
    p = col(p)
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
    )


def _complete(x, y):
    x, y = finite(x), finite(y)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def corr(x, y) -> Column:
    """Pearson aggregate over complete pairs; NULL for constant input instead of a division error."""
    x, y = _complete(x, y)
    vx, vy = F.var_pop(x), F.var_pop(y)
    return F.when((vx > 0) & (vy > 0), F.covar_pop(x, y) / F.sqrt(vx) / F.sqrt(vy))


def slope(y, x) -> Column:
    """Least-squares slope aggregate over complete pairs; NULL for constant x."""
    x, y = _complete(x, y)
    return F.try_divide(F.covar_pop(x, y), F.var_pop(x))


def intercept(y, x) -> Column:
    cx, cy = _complete(x, y)
    return F.avg(cy) - slope(y, x) * F.avg(cx)


def corr_or_zero(x, y) -> Column:
    """Pearson aggregate that is 0 for constant input."""
    return F.coalesce(corr(x, y), F.lit(0.0))


def clean_label(c) -> Column:
    """Label without what follows its first dot."""
    return F.substring_index(col(c), ".", 1)


def row_mean(cols) -> Column:
    """Mean over columns, only where all of them are present."""
    cols = [col(c) for c in cols]
    total = reduce(lambda a, b: a + b, cols)
    return total / len(cols)


def number(c) -> Column:
    """Text to number, NULL where the text is no number."""
    return col(c).try_cast("double")


def key_hash(key, *salts) -> Column:
    """Repeatable integer in [0, 2^60) from an integer key and integer salts: the head of an MD5.

    Any SQL engine gives the same value, and another salt gives an unrelated order of the keys.
    """
    parts = [(F.lit(s) if isinstance(s, int) else col(s)).cast("bigint").cast("string") for s in (key, *salts)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("bigint")


def exact_avg(c, places: int = 12) -> Column:
    """Average of decimal numbers that are stored as doubles, free of the order in which they are added.

    Numbers count to ``places`` decimals; where a group holds NaN, infinity or numbers of more than 17 digits before
    the point, it is the plain average.
    """
    c = col(c).cast("double")
    odd = F.coalesce(F.isnan(c) | (F.abs(c) >= 1e17), F.lit(False))
    whole = F.sum(F.when(~odd, c).try_cast(f"decimal(30,{places})"))
    return F.when(F.max(odd), F.avg(c)).otherwise(whole.cast("double") / F.count(c))
