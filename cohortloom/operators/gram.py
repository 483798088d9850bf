"""Grouped sufficient statistics: the augmented cross-product matrix of a row vector.

Row format of every table made here: the keys and ``_gram``, the packed upper triangle of
``sum([1, x] [1, x]')``. It is additive, so folds, complements, pooling and bootstraps are sums and
differences of ``_gram``, and rows are read once. Its size depends on the number of columns
only, never on the number of rows.

Sums of raw products lose a small spread around a large mean. ``moments`` keeps (n, mean, products
around the mean) instead and merges them pairwise; its ``_gram`` lies around the key's own mean, which
is all that slopes, covariances and components need.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from cohortloom.functions.small import pack
from cohortloom.session import parallelism

NARROW = 16  # up to this many columns the sums run as plain SQL aggregates
FLUSH_FLOATS = 4_000_000  # cells a task keeps before it emits its partial sums
SEGMENT = 4096  # cells of a matrix that one task adds up
STEP_BYTES = 4 << 20  # Arrow data that become objects of a worker at a time


def gram_narrow(df: DataFrame, keys, cols) -> DataFrame:
    """Cross-products of a few columns as built-in sums with map-side combine."""
    full = [F.lit(1.0), *[F.col(c).cast("double") for c in cols]]
    rows = df.dropna(subset=list(cols))
    sums, names = [], []
    for i in range(len(full)):
        for j in range(i, len(full)):
            names.append(f"_g{i}_{j}")
            sums.append(F.sum(full[i] * full[j]).alias(names[-1]))
    return rows.groupBy(*keys).agg(*sums).select(*keys, F.array(*names).alias("_gram"))


def _runs(pdf: pd.DataFrame, keys) -> np.ndarray:
    """Start of every run of equal keys in sorted rows."""
    new = np.zeros(len(pdf), dtype=bool)
    new[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _batch_grams(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Packed cross-products of every run of rows."""
    p = x.shape[1]
    if p > 40 or len(starts) == 1:
        ends = np.append(starts[1:], len(x))
        return np.stack([pack(x[a:b].T @ x[a:b]) for a, b in zip(starts, ends, strict=True)])
    i, j = np.triu_indices(p)
    return np.add.reduceat(x[:, i] * x[:, j], starts, axis=0)


def gram_wide(df: DataFrame, keys, vec: str, width: int) -> DataFrame:
    """Cross-products of an array column: partial matrices per task, then summed per key.

    A task emits one partial matrix per key it meets. Where keys have few rows each, cluster the
    rows by the key and a bounded slice of it first (as the encoding design does), so that the
    partial matrices do not outgrow the rows.
    """
    keys = list(keys)
    p = width + 1
    schema = StructType([*[df.schema[k] for k in keys], StructField("_gram", ArrayType(DoubleType()))])

    def partial(batches):
        held: dict = {}

        def flush():
            out = pd.DataFrame(list(held), columns=keys) if keys else pd.DataFrame(index=range(1))
            out["_gram"] = list(held.values())
            held.clear()
            return out

        for pdf in batches:
            if pdf.empty:
                continue
            if keys:
                pdf = pdf.sort_values(keys, kind="stable", ignore_index=True)
            x = np.ones((len(pdf), p))
            x[:, 1:] = np.vstack(pdf[vec].to_numpy())
            starts = _runs(pdf, keys) if keys else np.array([0])
            grams = _batch_grams(x, starts)
            names = pdf[keys].iloc[starts].itertuples(index=False, name=None) if keys else [()]
            for key, g in zip(names, grams, strict=True):
                held[key] = held[key] + g if key in held else g
            if len(held) * grams.shape[1] > FLUSH_FLOATS:
                yield flush()
        if held:
            yield flush()

    parts = df.filter(F.col(vec).isNotNull()).select(*keys, vec).mapInPandas(partial, schema)
    return sum_grams(parts, keys)


def gram_shared(df: DataFrame, keys, codes: str, vec: str, width: int) -> DataFrame:
    """``(keys, code, _gram)`` of rows that count under several codes each (``codes``, an array of numbers).

    A row travels once, whatever the number of its codes. Keys are few in a batch where rows are clustered by them.
    """
    keys = list(keys)
    schema = StructType([*[df.schema[k] for k in keys], StructField("code", IntegerType()), StructField("_gram", ArrayType(DoubleType()))])

    def partial(batches):
        held: dict = {}

        def flush():
            out = pd.DataFrame(list(held), columns=[*keys, "code"])
            out["_gram"] = list(held.values())
            held.clear()
            return out

        for pdf in batches:
            if pdf.empty:
                continue
            pdf = pdf.sort_values(keys, kind="stable", ignore_index=True) if keys else pdf
            x = np.ones((len(pdf), width + 1))
            x[:, 1:] = np.vstack(pdf[vec].to_numpy())
            starts = _runs(pdf, keys) if keys else np.array([0])
            names = pdf[keys].iloc[starts].itertuples(index=False, name=None) if keys else [()]
            lists = pdf[codes].to_numpy()
            for key, a, b in zip(names, starts, np.append(starts[1:], len(pdf)), strict=True):
                code = np.concatenate(lists[a:b]).astype(int)
                row = np.repeat(np.arange(a, b), [len(c) for c in lists[a:b]])
                order = np.argsort(code, kind="stable")
                found, at = np.unique(code[order], return_index=True)
                for c, rows in zip(found.tolist(), np.split(row[order], at[1:]), strict=True):
                    g = pack(x[rows].T @ x[rows])
                    name = (*key, c)
                    held[name] = held[name] + g if name in held else g
            if len(held) * (width + 1) * (width + 2) // 2 > FLUSH_FLOATS:
                yield flush()
        if held:
            yield flush()

    parts = df.filter(F.col(vec).isNotNull() & (F.size(codes) > 0)).select(*keys, codes, vec).mapInPandas(partial, schema)
    return sum_grams(parts, [*keys, "code"])


def gram(df: DataFrame, keys, cols) -> DataFrame:
    cols = list(cols)
    if len(cols) <= NARROW:
        return gram_narrow(df, keys, cols)
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    return gram_wide(df.dropna(subset=cols).select(*keys, vec.alias("_x")), keys, "_x", len(cols))


def sum_grams(df: DataFrame, keys, name: str = "_gram") -> DataFrame:
    """Sum of packed arrays per key.

    Arrays are cut into segments, so that one key's arrays from many tasks are added up by several
    tasks; rows arrive sorted and are added as they stream by.
    """
    keys = list(keys)
    one = [] if keys else [F.lit(0).alias("_one")]
    by = keys or ["_one"]
    count = F.ceil(F.size(name) / SEGMENT).cast("int")
    cut_up = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(name, i * SEGMENT + 1, F.lit(SEGMENT)))
    seg = df.filter(F.size(name) > 0).select(*keys, *one, F.posexplode(cut_up).alias("_seg", "_v"))
    order = [*by, "_seg"]
    schema = StructType([*[seg.schema[c] for c in order], StructField("_v", ArrayType(DoubleType()))])

    def add(batches):
        last = None
        for pdf in batches:
            if pdf.empty:
                continue
            starts = _runs(pdf, order)
            lengths = pdf["_v"].iloc[starts].map(len).to_numpy()
            out = pdf[order].iloc[starts].reset_index(drop=True)
            if (lengths == lengths[0]).all():
                out["_v"] = list(np.add.reduceat(np.vstack(pdf["_v"].to_numpy()), starts, axis=0))
            else:
                ends = np.append(starts[1:], len(pdf))
                out["_v"] = [np.sum(np.vstack(pdf["_v"].iloc[a:b].to_numpy()), axis=0) for a, b in zip(starts, ends, strict=True)]
            if last is not None:
                if tuple(last[order].iloc[0]) == tuple(out[order].iloc[0]):
                    out.at[0, "_v"] = out.at[0, "_v"] + last["_v"].iloc[0]
                else:
                    yield last
            last = out.iloc[-1:].reset_index(drop=True)
            if len(out) > 1:
                yield out.iloc[:-1]
        if last is not None:
            yield last

    summed = map_slices(seg.repartition(*order).sortWithinPartitions(*order), add, schema)
    # Segments of a key, put in order; their number is fixed by the width of the matrix.
    packed = F.array_sort(F.collect_list(F.struct("_seg", "_v")))
    out = summed.groupBy(*by).agg(F.flatten(F.transform(packed, lambda s: s["_v"])).alias(name))
    return out.select(*keys, name)


def moments_narrow(df: DataFrame, keys, cols) -> DataFrame:
    """``moments`` of a few columns by the built-in covariances, whose buffers merge around their means."""
    x = [F.col(c).cast("double") for c in cols]
    names = [f"_c{i}_{j}" for i in range(len(x)) for j in range(i, len(x))]
    pairs = [(F.var_pop(x[i]) if i == j else F.covar_pop(x[i], x[j])) for i in range(len(x)) for j in range(i, len(x))]
    n = F.col("_n")
    sums = df.dropna(subset=list(cols)).groupBy(*keys).agg(
        F.count("*").cast("double").alias("_n"), F.array(*map(F.avg, x)).alias("_mean"), *[c.alias(a) for c, a in zip(pairs, names, strict=True)]
    )
    sums = sums.filter(n > 0)
    return sums.select(*keys, "_n", "_mean", F.array(n, *[F.lit(0.0)] * len(x), *[F.col(a) * n for a in names]).alias("_gram"))


def pool(n: np.ndarray, mean: np.ndarray, m2: np.ndarray, starts: np.ndarray, cell: tuple[np.ndarray, np.ndarray]):
    """Merge of every run of (n, mean, products around the mean); ``cell`` holds row and column of the products."""
    total = np.add.reduceat(n, starts)
    whole = np.add.reduceat(n[:, None] * (mean - mean[np.repeat(starts, np.diff(np.append(starts, len(n))))]), starts, axis=0)
    centre = mean[starts] + whole / total[:, None]
    d = np.sqrt(n)[:, None] * (mean - np.repeat(centre, np.diff(np.append(starts, len(n))), axis=0))
    return total, centre, np.add.reduceat(m2 + d[:, cell[0]] * d[:, cell[1]], starts, axis=0)


def moments_wide(df: DataFrame, keys, vec: str, width: int) -> DataFrame:
    """``moments`` of an array column: partial moments per task and key, then merged per key and segment."""
    keys = list(keys)
    cell = np.triu_indices(width)
    array = ArrayType(DoubleType())
    fields = [StructField("_n", DoubleType()), StructField("_mean", array), StructField("_m2", array)]
    schema = StructType([*[df.schema[k] for k in keys], *fields])

    def partial(batches):
        held: dict = {}

        def flush():
            out = pd.DataFrame(list(held), columns=keys) if keys else pd.DataFrame(index=range(1))
            for i, name in enumerate(("_n", "_mean", "_m2")):
                out[name] = [v[i] for v in held.values()]
            held.clear()
            return out

        for pdf in batches:
            if pdf.empty:
                continue
            if keys:
                pdf = pdf.sort_values(keys, kind="stable", ignore_index=True)
            x = np.vstack(pdf[vec].to_numpy()).astype(float)
            starts = _runs(pdf, keys) if keys else np.array([0])
            names = pdf[keys].iloc[starts].itertuples(index=False, name=None) if keys else [()]
            for key, a, b in zip(names, starts, np.append(starts[1:], len(x)), strict=True):
                mean = x[a:b].mean(axis=0)
                d = x[a:b] - mean
                new = (float(b - a), mean, pack(d.T @ d))
                if key in held:
                    both = [np.stack([np.asarray(u), np.asarray(v)]) for u, v in zip(held[key], new, strict=True)]
                    new = tuple(v[0] for v in pool(*both, np.array([0]), cell))
                held[key] = new
            if len(held) * len(cell[0]) > FLUSH_FLOATS:
                yield flush()
        if held:
            yield flush()

    return merge_moments(df.filter(F.col(vec).isNotNull()).select(*keys, vec).mapInPandas(partial, schema), keys, width)


def merge_moments(parts: DataFrame, keys, width: int) -> DataFrame:
    """``moments`` per key of parts (``_n``, ``_mean``, ``_m2``); products are cut into segments for several tasks."""
    keys = list(keys)
    one = [] if keys else [F.lit(0).alias("_one")]
    by = keys or ["_one"]
    order = [*by, "_seg"]
    count = F.ceil(F.size("_m2") / SEGMENT).cast("int")
    cut_up = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("_m2", i * SEGMENT + 1, F.lit(SEGMENT)))
    seg = parts.select(*keys, *one, "_n", "_mean", F.posexplode(cut_up).alias("_seg", "_v"))
    rows, cols = np.triu_indices(width)

    def add(batches):
        last = None
        for pdf in batches:
            if pdf.empty:
                continue
            pdf = pdf if last is None else pd.concat([last, pdf], ignore_index=True)
            starts = _runs(pdf, order)
            out = []
            for a, b in zip(starts, np.append(starts[1:], len(pdf)), strict=True):
                at = int(pdf["_seg"].iloc[a]) * SEGMENT
                cell = (rows[at : at + SEGMENT], cols[at : at + SEGMENT])
                run = pdf.iloc[a:b]
                out.append([v[0] for v in pool(run["_n"].to_numpy(), np.vstack(run["_mean"]), np.vstack(run["_v"]), np.array([0]), cell)])
            made = pdf[order].iloc[starts].reset_index(drop=True)
            for i, name in enumerate(("_n", "_mean", "_v")):
                made[name] = [v[i] for v in out]
            last = made.iloc[-1:].reset_index(drop=True)
            if len(made) > 1:
                yield made.iloc[:-1]
        if last is not None:
            yield last

    merged = map_slices(seg.repartition(*order).sortWithinPartitions(*order), add, seg.select(*order, "_n", "_mean", "_v").schema)
    packed = F.array_sort(F.collect_list(F.struct("_seg", "_v")))
    whole = merged.groupBy(*by).agg(F.min_by("_n", "_seg").alias("_n"), F.min_by("_mean", "_seg").alias("_mean"), F.flatten(F.transform(packed, lambda s: s["_v"])).alias("_m2"))
    head = F.concat(F.array("_n"), F.array_repeat(F.lit(0.0), width))
    return whole.select(*keys, "_n", "_mean", F.concat(head, "_m2").alias("_gram"))


def moments(df: DataFrame, keys, cols) -> DataFrame:
    """``(keys, _n, _mean, _gram)``: augmented cross-products around the key's own mean, of complete rows."""
    cols = list(cols)
    if len(cols) <= NARROW:
        return moments_narrow(df, keys, cols)
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    return moments_wide(df.dropna(subset=cols).select(*keys, vec.alias("_x")), keys, "_x", len(cols))


def complement(grams: DataFrame, keys, part: str) -> DataFrame:
    """Total minus part: the training sums of every held-out part."""
    from cohortloom.operators.temporal import join_stats

    total = sum_grams(grams, keys).withColumnRenamed("_gram", "_t")
    j = join_stats(grams, total, keys)
    return j.select(*keys, part, F.zip_with("_t", "_gram", lambda t, g: t - g).alias("_gram"))


def map_slices(df: DataFrame, fn: Callable, schema: StructType) -> DataFrame:
    """``mapInPandas`` over frames of at most ``STEP_BYTES``: Spark cuts batches by rows, however wide these are, and
    wide rows outgrow a worker as objects long before they do so as Arrow columns."""
    target = to_arrow_schema(schema)

    def run(batches):
        def frames():
            for batch in batches:
                step = max(1, STEP_BYTES * batch.num_rows // max(batch.nbytes, 1))
                for at in range(0, batch.num_rows, step):
                    yield batch.slice(at, step).to_pandas()

        for out in fn(frames()):
            yield pa.RecordBatch.from_pandas(out, schema=target, preserve_index=False)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, keys, fn: Callable[[pd.DataFrame], pd.DataFrame], schema, spread: bool = True) -> DataFrame:
    """Run a small-matrix step over rows that each hold one key's sums."""
    def run(frames):
        for pdf in frames:
            out = fn(pdf)
            if len(out):
                yield out

    d = df.repartition(parallelism(df), *keys) if spread and keys else df
    return map_slices(d, run, schema)


def key_fields(df: DataFrame, keys) -> list[StructField]:
    return [df.schema[k] for k in keys]


def check_width(width: int, limit: int = 4096) -> None:
    if width > limit:
        raise ValueError(f"{width} columns: a {width} x {width} matrix per key does not fit a task")


def triangle(position: str, width: int) -> tuple[Column, Column]:
    """Row and column of a position in a packed upper triangle of ``width`` columns."""
    p, odd = F.col(position), 2 * width + 1
    i = F.floor((odd - F.sqrt((odd * odd - 8 * p).cast("double"))) / 2).cast("int")
    return i, (p - F.floor(i * (odd - i) / 2) + i).cast("int")


def cells(grams: DataFrame, keys, width: int) -> DataFrame:
    """Long form: one row per matrix cell ``(i, j, value)`` with 0 as the intercept."""
    i, j = triangle("_p", width + 1)
    return grams.select(*keys, F.posexplode("_gram").alias("_p", "value")).select(*keys, i.alias("i"), j.alias("j"), "value")
