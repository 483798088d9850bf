"""Shared response model: subjects rotated into one common time course."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from cohortloom.operators.axis import pca, pca_scores
from cohortloom.operators.gram import STEP_BYTES, check_width, key_fields, map_rows, sum_grams
from cohortloom.session import cut, parallelism

SPAN = 512  # most time points in a row of packed signals
SPAN_CELLS = 2048  # values of such a row


def _packed(signal: DataFrame, subject: str, t: str, v: int) -> DataFrame:
    """``(subject, _span, at, x)``: the time points of a subject and span in order, and their values end to end."""
    span = F.floor(F.col(t) / max(1, min(SPAN, SPAN_CELLS // v))).cast("int").alias("_span")
    rows = signal.select(subject, span, F.struct(F.col(t).alias("t"), F.col("vec").cast("array<double>").alias("x")).alias("_p"))
    # A fixed number of tasks, so that Spark keeps to this layout when bases come to their rows.
    rows = rows.repartition(parallelism(signal), subject, "_span")
    sorted_ = rows.groupBy(subject, "_span").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return sorted_.select(subject, "_span", F.transform("_p", lambda p: p["t"]).alias("at"), F.flatten(F.transform("_p", lambda p: p["x"])).alias("x"))


def _stacks(batches: Iterator[pa.RecordBatch], v: int) -> Iterator[tuple]:
    """(slice, rows, time points, values by row, point and parcel) of the rows of a slice that have the same points."""
    for whole in batches:
        step = max(1, STEP_BYTES * whole.num_rows // max(whole.nbytes, 1))
        for lo in range(0, whole.num_rows, step):
            batch = whole.slice(lo, step)
            ends = np.r_[0, np.cumsum(pc.list_value_length(batch.column("at")).to_numpy(zero_copy_only=False))]
            t, x = batch.column("at").flatten().to_numpy(), batch.column("x").flatten().to_numpy()
            same: dict = {}
            for i in range(batch.num_rows):
                same.setdefault(t[ends[i] : ends[i + 1]].tobytes(), []).append(i)
            for rows in same.values():
                i = rows[0]
                stack = np.stack([x[v * ends[r] : v * ends[r + 1]] for r in rows])
                yield batch, np.array(rows), t[ends[i] : ends[i + 1]], stack.reshape(len(rows), -1, v)


def _lists(values: np.ndarray) -> pa.ListArray:
    """One list for each row of a matrix."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), pa.float64()))


def _cross(packed: DataFrame, state, subject: str, v: int) -> DataFrame:
    """Per subject ``sum_t x_t s_t'`` as a packed v x k array, combined from its spans."""
    schema = StructType([*key_fields(packed, [subject]), StructField("m", ArrayType(DoubleType()))])
    target = to_arrow_schema(schema)

    def partial(batches):
        points, shared = state.value
        for batch, rows, t, x in _stacks(batches, v):
            m = x.transpose(0, 2, 1) @ shared[np.searchsorted(points, t)]
            yield pa.RecordBatch.from_arrays([batch.column(subject).take(pa.array(rows)), _lists(m.reshape(len(rows), -1))], schema=target)

    return sum_grams(packed.select(subject, "at", "x").mapInArrow(partial, schema), [subject], "m")


def _bases(cross: DataFrame, subject: str, v: int, k: int) -> DataFrame:
    schema = StructType([*key_fields(cross, [subject]), StructField("w", ArrayType(DoubleType()))])

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        u, _, vt = np.linalg.svd(np.vstack(pdf["m"].to_numpy()).reshape(-1, v, k), full_matrices=False)
        return pd.DataFrame({subject: pdf[subject], "w": list((u @ vt).reshape(len(pdf), -1))})

    return map_rows(cross, [subject], step, schema)


def _with_basis(packed: DataFrame, spans: DataFrame, bases: DataFrame, subject: str) -> DataFrame:
    """The rows beside their subject's basis; only bases travel."""
    return packed.join(spans.join(bases.hint("merge"), subject).hint("merge"), [subject, "_span"])


def _basis(batch: pa.RecordBatch, rows: np.ndarray, v: int) -> np.ndarray:
    return batch.column("w").take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), v, -1)


def _next_course(rows: DataFrame, state, v: int, k: int) -> np.ndarray:
    """Mean of the subjects seen through their bases, one row for each time point; tasks return sums."""
    schema = StructType([StructField("p", IntegerType()), StructField("s", ArrayType(DoubleType()))])
    target = to_arrow_schema(schema)

    def sums(batches):
        points = state.value[0]
        total = np.zeros((len(points), k + 1))
        for batch, of, t, x in _stacks(batches, v):
            at = np.searchsorted(points, t)
            total[at, :k] += (x @ _basis(batch, of, v)).sum(axis=0)
            total[at, k] += len(of)
        met = np.flatnonzero(total[:, k])
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), _lists(total[met])], schema=target)

    new = np.array(state.value[1])
    for r in sum_grams(rows.select("at", "x", "w").mapInArrow(sums, schema), ["p"], "s").collect():  # one row for each time point
        new[r.p] = np.array(r.s[:k]) / r.s[k]
    return new


def _fitted(rows: DataFrame, state, subject: str, t: str, v: int) -> DataFrame:
    """The shared course back in the parcels of every subject."""
    schema = StructType([*key_fields(rows, [subject]), StructField(t, rows.schema["at"].dataType.elementType), StructField("fitted", ArrayType(DoubleType()))])
    target = to_arrow_schema(schema)

    def back(batches):
        points, shared = state.value
        for batch, of, at, _ in _stacks(batches, v):
            y = shared[np.searchsorted(points, at)] @ _basis(batch, of, v).transpose(0, 2, 1)
            who = batch.column(subject).take(pa.array(np.repeat(of, len(at))))
            yield pa.RecordBatch.from_arrays([who, pa.array(np.tile(at, len(of)), target.field(1).type), _lists(y.reshape(-1, v))], schema=target)

    return rows.select(subject, "at", "x", "w").mapInArrow(back, schema)


def _mean_vector(df: DataFrame, t: str, vec: str, out: str) -> DataFrame:
    # Means cell by cell with map-side combine: a time point has as many rows as there are subjects.
    cells = df.select(t, F.posexplode(vec).alias("_i", "_v")).groupBy(t, "_i").agg(F.avg("_v").alias("_v"))
    return cells.groupBy(t).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda c: c["_v"]).alias(out))


def shared_response(signal: DataFrame, subject: str, t: str, v: int, k: int, n_iter: int = 10):
    """Deterministic shared response of packed signals ``(subject, t, vec)``.

    Starts from the first ``k`` principal courses of the cohort mean, which do not depend on the order of
    the parcels, then alternates: each subject's basis is the orthogonal Procrustes fit of its signal to the shared course, the shared course the mean of
    the subjects seen through their bases. The signals are packed by subject and span once and stay where they are; an
    iteration moves bases, and the driver holds the course, ``k`` numbers for each time point.
    Returns (bases, shared, fitted signals).
    """
    check_width(v)
    spark = signal.sparkSession
    mean = cut(_mean_vector(signal, t, "vec", "m"))
    courses = pca_scores(mean, pca(mean, [], "m", v, k), [], [t], "m")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("comp", "score"))), lambda c: c["score"])
    first = courses.groupBy(t).agg(in_order.alias("s")).orderBy(t).collect()  # one row for each time point
    points, course = np.array([r[t] for r in first]), np.array([r.s for r in first], dtype=float)
    packed = _packed(signal, subject, t, v).persist()
    spans = cut(packed.select(subject, "_span"))
    bases = None
    for _ in range(n_iter):
        state = spark.sparkContext.broadcast((points, course))
        bases = cut(_bases(_cross(packed, state, subject, v), subject, v, course.shape[1]))
        course = _next_course(_with_basis(packed, spans, bases, subject), state, v, course.shape[1])
        state.unpersist()
    shared = spark.createDataFrame([(p, c) for p, c in zip(points.tolist(), course.tolist(), strict=True)], StructType([signal.schema[t], StructField("s", ArrayType(DoubleType()))]))
    fitted = _fitted(_with_basis(packed, spans, bases, subject), spark.sparkContext.broadcast((points, course)), subject, t, v)
    return bases, shared, fitted
