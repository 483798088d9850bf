"""Encoding at width: blocks against the narrow path and against plain ridge fits, and the configuration grid."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions.small import unpack
from cohortloom.operators import blocks as BL
from cohortloom.operators import encode as E
from cohortloom.operators.gram import gram_wide
from cohortloom.operators.temporal import block_holdout

NT, NC, SIDE = 60, 9, 3
KW = dict(length=5, frac=4, n_boot=3, seed=1)
FEATURES, DELAYS, TARGETS = ["f", "g"], [1, 2], list(range(7))
ALPHAS = (0.5, 20.0, 300.0)
NX = len(FEATURES) * len(DELAYS)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    reg = [(s, f, t, float(rng.normal())) for s in "ab" for f in FEATURES for t in range(NT)]
    x = {(s, f, t): v for s, f, t, v in reg}
    sig = [(s, v, t, float(rng.normal() + 0.7 * v * x.get((s, "f", t - 1), 0.0) + 50 * v)) for s in "ab" for v in TARGETS for t in range(NT)]
    regressors = spark.createDataFrame(reg, "subject string, feature string, t int, x double")
    signal = spark.createDataFrame(sig, "subject string, parcel int, t int, y double")
    rows = BL.feature_rows(regressors, "subject", "t", FEATURES, DELAYS)
    places = BL.place_targets(signal, "parcel", 3)
    spectra = BL.factors(rows, "subject", "t", NX, NT, NC, **KW)
    return regressors, signal, rows, places, spectra


def test_layout_holds_out_what_block_holdout_draws(spark):
    layout = E.time_layout(NT, NC, 5, 4, 3, 1)
    folds = np.array([f for _, f, _ in layout])
    for fold in range(SIDE):
        train = np.flatnonzero(folds != fold)
        blocks = spark.range(len(train) // 5).select(F.col("id").cast("int").alias("block"), F.lit(fold).alias("f"))
        drawn = {(r.boot, r.block) for r in block_holdout(blocks, ["f"], "block", 3, 4, 1).collect()}
        held = {(c % 4 - 1, i // 5) for i, t in enumerate(train) for c in layout[t][2] if c // 4 == fold and c % 4}
        assert held == drawn


def test_blocks_agree_with_the_narrow_path(series):
    regressors, signal, rows, places, spectra = series
    design = E.design(regressors, signal, "subject", "t", FEATURES, DELAYS, TARGETS)
    path = E.ridge_path(E.boot_grams(design, "subject", "t", NX + len(TARGETS), NT, NC, **KW), "subject", NX, ALPHAS)
    long = path.select("subject", "test_fold", "alpha_id", F.posexplode("scores").alias("parcel", "s"))
    want = {tuple(r)[:4]: r.s for r in long.groupBy("subject", "test_fold", "alpha_id", "parcel").agg(F.avg("s").alias("s")).collect()}
    wide = BL.blocked_path(rows, signal, places, spectra, "subject", "t", "parcel", 3, NT, NC, alphas=ALPHAS, **KW)
    got = {tuple(r)[:4]: r.s for r in BL.by_target(wide, places, "parcel", ["subject", "test_fold", "alpha_id"], s="scores").collect()}
    assert got.keys() == want.keys() and len(got) == 2 * 3 * 3 * 7
    assert max(abs(got[k] - want[k]) for k in got) < 1e-9

    picked = BL.blocked_alpha(wide, "subject")
    alphas = {tuple(r)[:3]: r.a for r in BL.by_target(picked, places, "parcel", ["subject", "test_fold"], a="alphas").collect()}
    narrow = {(r.subject, r.test_fold, r.target): r.alpha for r in E.select_alpha(path, "subject", "target").collect()}
    assert alphas == narrow
    one, other = BL.blocked_pooled_alpha(wide, "subject").first(), E.pooled_alpha(path, "subject").first()
    assert one.alpha == other.alpha and abs(one.score - other.score) < 1e-9

    # Refit at the penalty of each target.
    table = E.select_alpha(path, "subject", "target").groupBy("subject", F.col("test_fold").alias("fold")).agg(F.transform(F.array_sort(F.collect_list(F.struct("target", "alpha"))), lambda s: s["alpha"]).alias("alpha"))
    fit = E.ridge_fit(E.fold_grams(design, "subject", "t", NX + len(TARGETS), NT, NC, length=7), table, "subject", NX)
    want = {(r.subject, r.fold, r.target): (r.r, r.r_split) for r in fit.select("subject", "fold", F.posexplode(F.arrays_zip("r", "r_split")).alias("target", "z")).select("subject", "fold", "target", "z.*").collect()}
    made = BL.blocked_fit(rows, signal, places, spectra, picked, "subject", "t", "parcel", 3, NT, NC, length=7)
    got = {(r.subject, r.fold, r.parcel): (r.r, r.s) for r in BL.by_target(made, places, "parcel", ["subject", "fold"], r="r", s="r_split").collect()}
    assert got.keys() == want.keys()
    assert np.allclose([got[k] for k in sorted(got)], [want[k] for k in sorted(got)], atol=1e-8)

    seen = BL.blocked_predictions(rows, signal, places, spectra, picked, "subject", "t", "parcel", 3, NT, NC)
    long = BL.by_target(seen, places, "parcel", ["subject", "fold", "t"], y="y", h="y_hat")
    by = {tuple(r)[:3]: r.r for r in long.groupBy("subject", "fold", "parcel").agg(F.corr("y", "h").alias("r")).collect()}
    assert max(abs(by[k] - got[k][0]) for k in by) < 1e-9


def test_covariate_changes_the_fit_and_not_the_scored_features(series):
    _, signal, rows, places, spectra = series
    alpha = rows.sparkSession.range(1).select(F.lit(5.0).alias("alpha"))
    all_in = BL.blocked_fit(rows, signal, places, spectra, alpha, "subject", "t", "parcel", 3, NT, NC)
    scored = BL.blocked_fit(rows, signal, places, spectra, alpha, "subject", "t", "parcel", 3, NT, NC, n_scored=2)
    a, b = all_in.orderBy("subject", "block", "fold").first(), scored.orderBy("subject", "block", "fold").first()
    wide, short = np.reshape(a.weights, (-1, NX)), np.reshape(b.weights, (-1, 2))
    assert np.allclose(wide[:, :2], short) and not np.allclose(a.r, b.r)


def test_thousands_of_targets(spark):
    n = 3800
    reg = spark.range(NT).select(F.lit("s").alias("subject"), F.lit("f").alias("feature"), F.col("id").cast("int").alias("t"), F.sin("id").alias("x"))
    signal = spark.range(NT * n).select(F.lit("s").alias("subject"), (F.col("id") % n).alias("parcel"), F.floor(F.col("id") / n).cast("int").alias("t"), F.cos(F.col("id") * 1.7).alias("y"))
    x = BL.feature_rows(reg, "subject", "t", ["f"], [1])
    places = BL.place_targets(signal, "parcel", 4)
    spectra = BL.factors(x, "subject", "t", 1, NT, NC, **KW)
    path = BL.blocked_path(x, signal, places, spectra, "subject", "t", "parcel", 4, NT, NC, alphas=(1.0,), **KW)
    assert path.agg(F.sum(F.size("scores"))).first()[0] == 3 * n
    assert BL.block_count(signal, "parcel", 1 << 20) == n // 8


def test_grid_equals_configurations_made_row_by_row(spark):
    rng = np.random.default_rng(6)
    nouns, verbs, delays, targets = 2, 1, 2, 3
    parts = rng.normal(size=(40, delays, 2 * nouns + verbs))
    y = rng.normal(size=(40, targets))
    rows = spark.createDataFrame([("k", [*map(float, p.ravel()), *map(float, v)]) for p, v in zip(parts, y)], "k string, row array<double>")
    base = gram_wide(rows, ["k"], "row", delays * (2 * nouns + verbs) + targets)
    made = E.config_grams(base, ["k"], nouns, verbs, delays, targets).collect()
    assert [(r.bias, r.verb_weight) for r in sorted(made, key=lambda r: r.config_id)] == [tuple(map(float, c)) for c in E.CONFIGURATIONS]
    for r in made:
        noun = (1 - r.bias) * parts[:, :, :nouns] + r.bias * parts[:, :, nouns : 2 * nouns]
        x = np.concatenate([noun, r.verb_weight * parts[:, :, 2 * nouns :]], axis=2).reshape(40, -1)
        full = np.column_stack([np.ones(40), x, y])
        assert np.allclose(unpack(np.array(r["_gram"])), full.T @ full)
