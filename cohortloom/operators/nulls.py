"""Spatial and outcome permutation nulls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cohortloom.functions.scalar import corr, key_hash
from cohortloom.operators.ordering import rank_table
from cohortloom.operators.stats import pearson
from cohortloom.operators.temporal import join_stats
from cohortloom.session import parallelism


CELLS = 1 << 22
"""Distances held at a time."""
RANGE_ROWS = 4096  # rows of a permutation that one window sorts, on average


def centroids(vertices: DataFrame, parcel: str, hemi: str) -> DataFrame:
    return vertices.groupBy(hemi, parcel).agg(*[F.avg(c).alias(c) for c in ("x", "y", "z")])


def _rotation(rng) -> np.ndarray:
    """Uniform random rotation: four normals, scaled to length one, are a random unit quaternion."""
    w, *v = rng.normal(size=4)
    v = np.array(v)
    cross = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + 2 * (w * cross + cross @ cross) / (w * w + v @ v)


def _nearest(points: np.ndarray, turned: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest free turned point of every point, and the squared distance; some rows of the distances at a time."""
    at, far = np.empty(len(points), int), np.empty(len(points))
    open_ = np.flatnonzero(free)
    for lo in range(0, len(points), step := max(1, CELLS // max(len(open_), 1))):
        part = slice(lo, lo + step)
        d = sum((points[part, c, None] - turned[None, open_, c]) ** 2 for c in range(points.shape[1]))
        hit = d.argmin(axis=1)
        at[part], far[part] = open_[hit], d[np.arange(len(hit)), hit]
    return at, far


def _assign(points: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Source index per parcel: the parcel whose nearest free point is farthest goes first.

    Every parcel remembers its nearest free point; only those that lose it to another look again, so no matrix of all
    distances is held and the work is quadratic in the parcels.
    """
    out, free = np.full(len(points), -1), np.ones(len(points), bool)
    at, far = _nearest(points, turned, free)
    for _ in range(len(points)):
        row = int(np.where(out < 0, far, -np.inf).argmax())
        hit = int(at[row])
        out[row], free[hit] = hit, False
        lost = np.flatnonzero((out < 0) & (at == hit))
        if len(lost):
            at[lost], far[lost] = _nearest(points[lost], turned, free)
    return out


def spin_permutations(cents: DataFrame, parcel: str, hemi: str, left, right, n: int, seed: int = 0) -> DataFrame:
    """``(rot, parcel, src)`` for ``n`` random rotations, mirrored for the right hemisphere.

    The atlas fixes the number of parcels; its centroids travel packed in one row for each task, and every
    rotation is one unit of work with its own seed.
    """
    spark = cents.sparkSession
    packed = cents.select(parcel, hemi, F.array("x", "y", "z").alias("c"))
    packed = packed.groupBy().agg(F.array_sort(F.collect_list(F.struct(parcel, hemi, "c"))).alias("_all"))
    tasks = max(1, min(n, parallelism(cents)))
    rots = spark.range(tasks).repartition(tasks, "id").select(F.sequence(F.col("id").cast("int"), F.lit(n - 1), F.lit(tasks)).alias("rots"))
    work = join_stats(rots, packed, [])
    schema = StructType([StructField("rot", IntegerType()), cents.schema[parcel], StructField("src", cents.schema[parcel].dataType)])
    mirror = np.diag([-1.0, 1.0, 1.0])

    def run(batches):
        for pdf in batches:
            for numbers, cells in zip(pdf["rots"], pdf["_all"], strict=True):
                ids = np.array([c[parcel] for c in cells])
                side = np.array([c[hemi] for c in cells])
                xyz = np.array([c["c"] for c in cells], dtype=float)
                for rot in numbers:
                    rng = np.random.default_rng([seed, int(rot)])
                    while True:
                        q = _rotation(rng)
                        src = ids.copy()
                        for which, m in ((left, q), (right, mirror @ q @ mirror)):
                            at = np.flatnonzero(side == which)
                            if len(at):
                                src[at] = ids[at][_assign(xyz[at], xyz[at] @ m)]
                        if len(ids) < 2 or not (src == ids).all():
                            break
                    yield pd.DataFrame({"rot": np.int32(rot), parcel: ids, "src": src})

    return work.mapInPandas(run, schema)


def spin_nulls(maps: DataFrame, perm: DataFrame, parcel: str, x: str, y: str, mask: DataFrame | None = None) -> DataFrame:
    """Null correlations ``(rot, side, r)``: full map spun, then restricted; pairs with NULL drop."""
    kept = maps if mask is None else maps.join(mask, parcel, "left_semi")
    out = None
    for side, (moved, fixed) in enumerate(((x, y), (y, x))):
        src = maps.select(F.col(parcel).alias("src"), F.col(moved).alias("_m"))
        j = perm.join(src, "src").join(kept.select(parcel, F.col(fixed).alias("_f")), parcel)
        j = j.filter(F.col("_m").isNotNull() & F.col("_f").isNotNull())
        r = j.groupBy("rot").agg(corr("_m", "_f").alias("r")).withColumn("side", F.lit(side))
        out = r if out is None else out.unionByName(r)
    return out


def p_from_nulls(nulls: DataFrame, observed: DataFrame, keys=(), two_tailed: bool = False) -> DataFrame:
    """Share of null correlations beyond the observed one, strictly if one-sided by its sign."""
    j = join_stats(nulls.select(*keys, F.col("r").alias("_null")).filter("_null is not null"), observed.select(*keys, "r"), list(keys))
    n, r = F.col("_null"), F.col("r")
    if two_tailed:
        beyond = F.abs(n) >= F.abs(r)
    else:
        beyond = F.when(r >= 0, n > r).otherwise(n < r)
    return j.groupBy(*keys).agg(
        F.first("r").alias("r"), F.avg(beyond.cast("double")).alias("p"), F.stddev_pop("_null").alias("null_sd"), F.count("*").alias("n_null")
    )


def compare_maps(maps: DataFrame, perm: DataFrame, parcel: str, x: str, y: str, mask=None, two_tailed: bool = False) -> DataFrame:
    """One row: r, parametric p, spin p, spread of the null."""
    kept = maps if mask is None else maps.join(mask, parcel, "left_semi")
    obs = pearson(kept, [], x, y)
    spin = p_from_nulls(spin_nulls(maps, perm, parcel, x, y, mask), obs, (), two_tailed)
    return join_stats(spin.withColumnRenamed("p", "p_spin"), obs.select(F.col("n").alias("n_parcels"), F.col("p").alias("p_parametric")), [])


def permuted_places(df: DataFrame, row_id: str, y: str, n_perm: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``(perm, y, _pos)`` and ``(row_id, _pos)``: the outcome that every position receives under a permutation, and the
    row at every position.

    Hashes are uniform, so equal ranges of them hold few rows each: a window sorts one range of one permutation, and
    the counts of the earlier ranges are added. Spark's size estimates do not see the rows that ``explode`` adds, so
    the rows are dealt out before it and no join may send them to every task.
    """
    ranges = max(1, -(-df.count() // RANGE_ROWS))
    perms = F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1)))
    rows = df.select(row_id, y).repartition(parallelism(df), row_id).select("*", perms.alias("perm"))
    rows = rows.withColumn("_h", key_hash(row_id, "perm", seed)).withColumn("_range", F.shiftright(F.shiftright("_h", 20) * ranges, 40).cast("int"))
    before = Window.partitionBy("perm").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("perm", "_range").agg(F.count("*").alias("_c"))
    offsets = offsets.select("perm", "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    # Row ids break hash ties.
    inside = F.row_number().over(Window.partitionBy("perm", "_range").orderBy("_h", row_id)) - 1
    moved = rows.withColumn("_in", inside).hint("merge").join(offsets.hint("merge"), ["perm", "_range"]).select("perm", y, (F.col("_off") + F.col("_in")).alias("_pos"))
    place = rank_table(df.select(row_id), [], row_id).select(row_id, F.col("_below").alias("_pos"))
    return moved, place


def permuted_outcome(df: DataFrame, row_id: str, y: str, n_perm: int, seed: int) -> DataFrame:
    """``(perm, row_id, y)``: outcomes shuffled over rows, the same way on every engine.

    Row of position i (by id) takes the outcome of the row at position i in hash order. No permutation is sorted as a
    whole.
    """
    moved, place = permuted_places(df, row_id, y, n_perm, seed)
    return moved.hint("merge").join(place.hint("merge"), "_pos").select("perm", row_id, y)


def permutation_p(perm_stats: DataFrame, observed: DataFrame, keys=()) -> DataFrame:
    """Share of permutations strictly above the observed value; NULL counts as not above."""
    j = join_stats(perm_stats.select(*keys, F.col("r").alias("_null")), observed.select(*keys, "r"), list(keys))
    above = F.coalesce((F.col("_null") > F.col("r")), F.lit(False))
    return j.groupBy(*keys).agg(F.first("r").alias("r"), F.count("*").alias("n_perm"), F.avg(above.cast("double")).alias("p"))
