"""Encoding models at vertex width: targets in blocks, one factorisation of the features for all of them.

The features of a subject are factored once for each test fold and bootstrap (``factors``). Targets are dealt into
blocks, so that the series of one block fit a task; a task joins a block with the subject's feature rows and factors,
and every penalty, bootstrap and fold is a product of matrices there. Cross-products of targets with each other are
never formed, so the number of targets is not limited; a subject's work is linear in it.

A target without a value at a time point has 0 there, as in the narrow design. A block in which a subject has no value
at all gives no rows for that subject.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from cohortloom.functions.small import unpack
from cohortloom.operators.axis import dense
from cohortloom.operators.encode import ALPHAS, BOOT_BLOCK, BOOT_FRACTION, EIGEN_CUT, N_BOOT, SPLIT_BLOCK, _standard, hold_codes
from cohortloom.operators.gram import check_width, gram_shared, key_fields, map_rows

TASK_BYTES = 64 << 20
"""Target values of one subject and block in a task."""

SLICE_BYTES = 16 << 20
"""Target values that are scored at a time; their z-scores and predictions take many times that."""


def feature_rows(regressors: DataFrame, subject: str, t: str, features, delays) -> DataFrame:
    """``(subject, t, x)``: features of each delay in turn, 0 before the start."""
    nf = len(features)
    check_width(nf * len(delays))
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")) - 1
    moved = regressors.select(subject, t, place.alias("_f"), F.col("x").alias("v"), F.posexplode(F.array(*[F.lit(d) for d in delays])).alias("_k", "_d"))
    xs = moved.filter("_f >= 0").select(subject, (F.col(t) + F.col("_d")).alias(t), F.struct((F.col("_k") * nf + F.col("_f")).cast("int").alias("_i"), F.col("v").cast("double").alias("_v")).alias("_e"))
    seen = regressors.groupBy(subject).agg(F.max(t).alias("_last"))
    # Points before the first delay have a row of zeros.
    xs = xs.unionByName(regressors.select(subject, t).distinct(), allowMissingColumns=True)
    rows = xs.groupBy(subject, t).agg(F.collect_list("_e").alias("_e")).join(seen, subject).filter(F.col(t) <= F.col("_last"))
    return rows.select(subject, t, dense("_e", nf * len(delays)).alias("x"))


def block_count(signal: DataFrame, target: str, n_points: int) -> int:
    """Blocks whose series take about ``TASK_BYTES`` of a task."""
    width = max(1, TASK_BYTES // (8 * n_points))
    return max(1, -(-signal.select(target).distinct().count() // width))


def place_targets(signal: DataFrame, target: str, n_blocks: int) -> DataFrame:
    """``(target, block, pos, size)``: every target's block and position in it."""
    block = F.pmod(F.xxhash64(target), F.lit(n_blocks)).cast("int").alias("block")
    one = Window.partitionBy("block")
    return signal.select(target).distinct().select(target, block).withColumns({"pos": F.row_number().over(one.orderBy(target)) - 1, "size": F.count("*").over(one)})


def factors(x: DataFrame, subject: str, t: str, nx: int, n_points: int, n_chunks: int, length: int = BOOT_BLOCK, frac: int = BOOT_FRACTION, n_boot: int = N_BOOT, seed: int = 42) -> DataFrame:
    """``(subject, test_fold, boot, mean, inv, w, q)``: z-scaling of the training rows of a fold and the spectrum of
    what a bootstrap leaves of them; boot -1 leaves everything."""
    codes = hold_codes(x.sparkSession, t, n_points, n_chunks, length, frac, n_boot, seed)
    grams = gram_shared(x.join(F.broadcast(codes), t), [subject], "codes", "x", nx)
    each = n_boot + 1
    grams = grams.select(subject, F.floor(F.col("code") / each).cast("int").alias("test_fold"), (F.col("code") % each - 1).alias("boot"), "_gram")
    whole = grams.filter("boot = -1").select(subject, "test_fold", F.col("_gram").alias("_whole"))
    keys = [subject, "test_fold", "boot"]
    array = ArrayType(DoubleType())
    schema = StructType([*key_fields(grams, keys), *[StructField(c, array) for c in ("mean", "inv", "w", "q")]])

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for key, g, total in zip(pdf[keys].itertuples(index=False, name=None), pdf["_gram"], pdf["_whole"], strict=True):
            total = unpack(total)
            left = total if key[2] < 0 else total - unpack(g)
            m = _standard(total)
            w, q = np.linalg.eigh(m @ left @ m.T)
            keep = w > EIGEN_CUT
            rows.append((*key, total[0, 1:] / total[0, 0], np.diag(m[:, 1:]), w[keep], q[:, keep].ravel()))
        return pd.DataFrame(rows, columns=[f.name for f in schema])

    return map_rows(grams.join(whole, [subject, "test_fold"]), keys, step, schema)


class _Subject:
    """Feature rows of a subject in time order, and the factors that belong to it."""

    def __init__(self, table: pd.DataFrame):
        rows = table[table["x"].notna()].sort_values("t")
        self.t, self.fold = rows["t"].to_numpy(), rows["fold"].to_numpy()
        self.x = np.vstack(rows["x"].to_numpy())
        self.codes = [frozenset(c) for c in rows["codes"]]
        self.factors = table[table["w"].notna()].sort_values(["test_fold", "boot"])

    def held(self, code: int) -> np.ndarray:
        return np.array([code in c for c in self.codes])

    def signals(self, left: pd.DataFrame, first: int = 0, last: int | None = None) -> np.ndarray:
        """Series of the targets at the positions from ``first`` to before ``last``."""
        size = int(left["size"].iloc[0])
        last = size if last is None else min(last, size)
        if last - first < size:
            left = left[left["pos"].between(first, last - 1)]
        y = np.zeros((len(self.t), last - first))
        at = np.searchsorted(self.t, left["t"].to_numpy())
        at[at == len(self.t)] = 0
        known = self.t[at] == left["t"].to_numpy()
        np.add.at(y, (at[known], left["pos"].to_numpy()[known] - first), left["y"].to_numpy()[known])
        return y


def _z(y: np.ndarray, by: np.ndarray) -> np.ndarray:
    """z-scores with the statistics of the rows ``by``; 0 for a constant column."""
    mean, sd = by.mean(axis=0), by.std(axis=0)
    return (y - mean) * np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 1e-12 * np.maximum(np.abs(mean), 1))


def _columns_corr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of equal columns, 0 where undefined."""
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    norm = (a * a).sum(axis=0) * (b * b).sum(axis=0)
    return np.divide((a * b).sum(axis=0), np.sqrt(norm), out=np.zeros(a.shape[1]), where=norm > 1e-20)


def _met(x: DataFrame, signal: DataFrame, places: DataFrame, more: DataFrame, subject: str, t: str, target: str, codes: DataFrame, n_blocks: int):
    """Both sides of the tasks: values of a (subject, block), and the subject's rows and factors for each block."""
    left = signal.join(places, target).select(subject, "block", F.col(t).alias("t"), "pos", "size", F.col("y").cast("double").alias("y"))
    rows = x.join(F.broadcast(codes), t).select(subject, F.col(t).alias("t"), "fold", "codes", "x")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    both = rows.withColumn("block", every).unionByName(more if "block" in more.columns else more.withColumn("block", every), allowMissingColumns=True)
    both = both.select(*[F.col(c).alias(c) for c in both.columns])
    return left.groupBy(subject, "block").cogroup(both.groupBy(subject, "block"))


def _block_scores(me: _Subject, left: pd.DataFrame, grid: np.ndarray, each: int) -> dict[int, np.ndarray]:
    """Mean score over the bootstraps by test fold: one row for each penalty, one column for each target of the block."""
    size, step = int(left["size"].iloc[0]), max(1, SLICE_BYTES // (8 * len(me.t)))
    folds = [(int(fold), spectra) for fold, spectra in me.factors[me.factors["boot"] >= 0].groupby("test_fold")]
    scores = {fold: np.zeros((len(grid), size)) for fold, _ in folds}
    for first in range(0, size, step):
        y = me.signals(left, first, first + step)
        for fold, spectra in folds:
            train = me.fold != fold
            zy = _z(y, y[train])
            total = scores[fold][:, first : first + step]
            for f in spectra.itertuples(index=False):
                held = me.held(fold * each + f.boot + 1)
                rest = train & ~held
                zx = (me.x - f.mean) * f.inv
                turned = zx @ f.q.reshape(len(f.mean), -1)
                aim = turned[rest].T @ zy[rest]
                seen = turned[held] - turned[held].mean(axis=0)
                for a, alpha in enumerate(grid):
                    total[a] += _columns_corr(seen @ (aim / (f.w + alpha)[:, None]), zy[held])
            total /= len(spectra)
    return scores


def blocked_path(x: DataFrame, signal: DataFrame, places: DataFrame, spectra: DataFrame, subject: str, t: str, target: str, n_blocks: int, n_points: int, n_chunks: int, length: int = BOOT_BLOCK, frac: int = BOOT_FRACTION, n_boot: int = N_BOOT, seed: int = 42, alphas=ALPHAS) -> DataFrame:
    """Held-out correlation of every penalty, its mean over the bootstraps: ``(subject, block, test_fold, alpha_id,
    alpha, scores)`` with one score for each position of the block."""
    codes = hold_codes(x.sparkSession, t, n_points, n_chunks, length, frac, n_boot, seed)
    grid, each = np.asarray(alphas, dtype=float), n_boot + 1
    fields = [("block", IntegerType()), ("test_fold", IntegerType()), ("alpha_id", IntegerType()), ("alpha", DoubleType()), ("scores", ArrayType(DoubleType()))]
    schema = StructType([*key_fields(x, [subject]), *[StructField(n, k) for n, k in fields]])

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            scores = _block_scores(_Subject(right), left, grid, each)
            out = [(*key, fold, a, alpha, row[a]) for fold, row in scores.items() for a, alpha in enumerate(grid)]
        return pd.DataFrame(out, columns=[s.name for s in schema])

    return _met(x, signal, places, spectra, subject, t, target, codes, n_blocks).applyInPandas(run, schema)


def blocked_alpha(path: DataFrame, subject: str) -> DataFrame:
    """First best penalty of every target: ``(subject, block, test_fold, alphas, scores)``."""
    keys = [subject, "block", "test_fold"]
    array = ArrayType(DoubleType())
    schema = StructType([*key_fields(path, keys), StructField("alphas", array), StructField("scores", array)])

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("alpha_id")
        scores = np.vstack(pdf["scores"].to_numpy())
        top = scores.argmax(axis=0)
        return pd.DataFrame([(*key, pdf["alpha"].to_numpy()[top], scores.max(axis=0))], columns=[s.name for s in schema])

    return path.groupBy(*keys).applyInPandas(best, schema)


def blocked_pooled_alpha(path: DataFrame, subject: str) -> DataFrame:
    """One penalty for the cohort: best mean over subjects of their mean over folds and targets."""
    total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + s)
    each = path.groupBy(subject, "alpha_id", "alpha").agg((F.sum(total) / F.sum(F.size("scores"))).alias("s"))
    mean = each.groupBy("alpha_id", "alpha").agg(F.avg("s").alias("score"))
    return mean.agg(F.max_by(F.struct("alpha", "score"), F.struct("score", -F.col("alpha_id"))).alias("_b")).select("_b.alpha", "_b.score")


def _fold_fits(me: _Subject, y: np.ndarray, length: int, n_scored: int) -> Iterator[tuple]:
    """(fold, time points, weights, held-out y and prediction in z-units, split-half correlation) of every fold."""
    for f in me.factors[me.factors["boot"] < 0].itertuples(index=False):
        alpha = np.atleast_1d(np.asarray(f.alphas, dtype=float))
        ok = np.isfinite(alpha)
        alpha = np.where(ok, alpha, np.median(alpha[ok]) if ok.any() else 0.0)
        test = me.fold == f.test_fold
        q = f.q.reshape(len(f.mean), -1)
        weights = q @ (((me.x[~test] - f.mean) * f.inv @ q).T @ _z(y[~test], y[~test]) / (f.w[:, None] + alpha[None, :]))
        weights = weights[:n_scored]
        zx, zy = _z(me.x[test][:, :n_scored], me.x[test][:, :n_scored]), _z(y[test], y[test])
        pos = np.arange(test.sum())
        half = pos % 2 if len(pos) <= length else pos // length % 2
        fits = []
        for h in (0, 1):
            a, b = zx[half == h], zy[half == h]
            w, v = np.linalg.eigh(a.T @ a)
            w, v = w[w > EIGEN_CUT], v[:, w > EIGEN_CUT]
            fits.append(zx @ (v @ (v.T @ (a.T @ b) / (w[:, None] + alpha[None, :]))))
        norm = np.sqrt((fits[0] ** 2).sum(axis=0) * (fits[1] ** 2).sum(axis=0))
        split = np.divide((fits[0] * fits[1]).sum(axis=0), norm, out=np.zeros_like(norm), where=norm > 0)
        yield int(f.test_fold), me.t[test], weights, zy, zx @ weights, np.clip(split, -0.999999, 0.999999)


def _with_alpha(spectra: DataFrame, alpha: DataFrame, subject: str) -> DataFrame:
    """Factors of whole training sets with the penalties that ``alpha`` gives: ``alphas`` by block or one ``alpha``."""
    whole = spectra.filter("boot = -1")
    if "alphas" in alpha.columns:
        return whole.join(alpha.select(subject, "block", "test_fold", "alphas"), [subject, "test_fold"])
    return whole.crossJoin(F.broadcast(alpha.agg(F.array(F.first(F.col("alpha").cast("double"))).alias("alphas"))))


def blocked_fit(x: DataFrame, signal: DataFrame, places: DataFrame, spectra: DataFrame, alpha: DataFrame, subject: str, t: str, target: str, n_blocks: int, n_points: int, n_chunks: int, length: int = SPLIT_BLOCK, n_scored: int | None = None) -> DataFrame:
    """Refit of every fold at the penalties of ``alpha`` (of ``blocked_alpha``, or one row with ``alpha``):
    ``(subject, block, fold, weights, r, r_split)``, weights target by target."""
    codes = hold_codes(x.sparkSession, t, n_points, n_chunks)
    array = ArrayType(DoubleType())
    schema = StructType([*key_fields(x, [subject]), StructField("block", IntegerType()), StructField("fold", IntegerType()), *[StructField(c, array) for c in ("weights", "r", "r_split")]])

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            me = _Subject(right)
            for fold, _, w, zy, hat, split in _fold_fits(me, me.signals(left), length, n_scored or me.x.shape[1]):
                out.append((*key, fold, w.T.ravel(), _columns_corr(zy, hat), split))
        return pd.DataFrame(out, columns=[s.name for s in schema])

    return _met(x, signal, places, _with_alpha(spectra, alpha, subject), subject, t, target, codes, n_blocks).applyInPandas(run, schema)


def blocked_predictions(x: DataFrame, signal: DataFrame, places: DataFrame, spectra: DataFrame, alpha: DataFrame, subject: str, t: str, target: str, n_blocks: int, n_points: int, n_chunks: int, n_scored: int | None = None) -> DataFrame:
    """Held-out rows of every block: ``(subject, block, fold, t, y, y_hat)``, arrays in z-units of the fold."""
    codes = hold_codes(x.sparkSession, t, n_points, n_chunks)
    array = ArrayType(DoubleType())
    schema = StructType([*key_fields(x, [subject]), StructField("block", IntegerType()), StructField("fold", IntegerType()), StructField("t", x.schema[t].dataType), StructField("y", array), StructField("y_hat", array)])

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            me = _Subject(right)
            for fold, points, _, zy, hat, _ in _fold_fits(me, me.signals(left), SPLIT_BLOCK, n_scored or me.x.shape[1]):
                out += [(*key, fold, *row) for row in zip(points, zy, hat, strict=True)]
        return pd.DataFrame(out, columns=[s.name for s in schema])

    return _met(x, signal, places, _with_alpha(spectra, alpha, subject), subject, t, target, codes, n_blocks).applyInPandas(run, schema)


def by_target(df: DataFrame, places: DataFrame, target: str, keys, **arrays: str) -> DataFrame:
    """Long form: one row for each target of a block; ``arrays`` names the new column of each array."""
    values: list[Column] = [F.col(a) for a in arrays.values()]
    long = df.select(*keys, "block", F.posexplode(F.arrays_zip(*values)).alias("pos", "_v"))
    named = [F.col(f"_v.{a}").alias(n) for n, a in arrays.items()]
    return long.join(places.select(target, "block", "pos"), ["block", "pos"]).select(*keys, target, *named)
