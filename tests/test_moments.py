"""Moments around the mean: exact merges, and models whose data lie far from zero."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.functions.small import unpack
from cohortloom.operators import glm as G
from cohortloom.operators import gram as GR
from cohortloom.operators.harmonize import combat


def test_pool_equals_one_pass():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4)) + 1e7
    cut, cell = [0, 1, 20, 33, 60], np.triu_indices(4)
    parts = [x[a:b] for a, b in zip(cut, cut[1:])]
    m2 = np.stack([((p - p.mean(0)).T @ (p - p.mean(0)))[cell] for p in parts])
    n, mean, got = GR.pool(np.array([float(len(p)) for p in parts]), np.stack([p.mean(0) for p in parts]), m2, np.array([0, 2]), cell)
    for i, rows in enumerate((x[:20], x[20:])):
        d = rows - rows.mean(0)
        assert n[i] == len(rows)
        np.testing.assert_allclose(mean[i], rows.mean(0), rtol=1e-15)
        np.testing.assert_allclose(got[i], (d.T @ d)[cell], rtol=1e-7, atol=1e-7)


@pytest.mark.parametrize("wide", [False, True])
def test_moments_far_from_zero(spark, wide, monkeypatch):
    monkeypatch.setattr(GR, "SEGMENT", 4)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * 0.5 + 1e6
    data = [(["a", None][i % 2], *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(data, "k string, u double, v double, w double").repartition(7)
    if wide:
        got = GR.moments_wide(df.select("k", F.array("u", "v", "w").alias("x")), ["k"], "x", 3)
    else:
        got = GR.moments(df, ["k"], ["u", "v", "w"])
    rows = {r["k"]: r for r in got.collect()}
    for i, k in enumerate(("a", None)):
        part = x[i::2]
        g = unpack(np.array(rows[k]["_gram"]))
        np.testing.assert_allclose(rows[k]["_mean"], part.mean(0), rtol=1e-14)
        np.testing.assert_allclose(g[1:, 1:], np.cov(part.T, ddof=0) * len(part), rtol=1e-6)
        assert g[0, 0] == rows[k]["_n"] == 150 and not g[0, 1:].any()


@pytest.mark.parametrize("shift", [0.0, 1e4, 1e6, 1e8])
def test_group_effect_does_not_depend_on_the_mean(spark, shift):
    rng = np.random.default_rng(2)
    rows = [(i % 2, float(20 + i % 7), float(0.46 * (i % 2) + rng.normal() * 0.5 + shift)) for i in range(200)]
    df = spark.createDataFrame(rows, "grp int, age double, y double").withColumn("k", F.lit(1))
    got = G.glm(df, ["k"], "y", ["grp", "age"]).first()
    y = np.array([r[2] for r in rows]) - shift
    x = np.column_stack([np.ones(200), [r[0] for r in rows], [r[1] for r in rows]])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    res = y - x @ beta
    t = beta[1] / np.sqrt(res @ res / 197 * inv[1, 1])
    assert got.tested and got.df == 197 and abs(got.t - t) < 1e-4


def test_constant_response_and_constant_term(spark):
    rows = [(i % 2, 1.0, 1e6 + 0.1 * i % 1, 1e6 / 3) for i in range(50)]
    df = spark.createDataFrame(rows, "grp int, one double, y double, c double").withColumn("k", F.lit(1))
    flat = G.glm(df, ["k"], "c", ["grp"]).first()
    assert (flat.t, flat.p, flat.tested) == (0.0, 1.0, False)
    assert G.glm(df, ["k"], "y", ["grp", "one"]).first().df == 48


def test_residual_far_from_zero(spark):
    rng = np.random.default_rng(3)
    c = rng.normal(size=80)
    df = spark.createDataFrame([(i, float(1e7 + v), float(1e7 + 2 * v + e)) for i, (v, e) in enumerate(zip(c, rng.normal(size=80)))], "i int, c double, y double").withColumn("k", F.lit(1))
    got = G.regress_out(df, ["k"], "y", ["c"]).toPandas().sort_values("i")
    r = got["residual"].to_numpy() - got["residual"].mean()
    assert abs(np.corrcoef(r, c)[0, 1]) < 1e-6 and abs(got["residual"].mean() - got["y"].mean()) < 1e-6


def test_harmonising_does_not_depend_on_the_mean(spark):
    rng = np.random.default_rng(4)
    rows = [("f", p, "ab"[i % 2], float(i % 5), float(rng.normal() + i % 2 + p)) for i in range(60) for p in range(4)]
    df = spark.createDataFrame(rows, "feature string, parcel int, site string, age double, y double").withColumn("i", F.monotonically_increasing_id())
    near = combat(df, "feature", "parcel", "site", "y", ["age"]).select("i", "harmonised").toPandas().sort_values("i")
    far = combat(df.withColumn("y", F.col("y") + 1e6 * F.col("parcel")), "feature", "parcel", "site", "y", ["age"]).withColumn("harmonised", F.col("harmonised") - 1e6 * F.col("parcel"))
    np.testing.assert_allclose(far.select("i", "harmonised").toPandas().sort_values("i")["harmonised"], near["harmonised"], atol=1e-6)


def test_wide_rows_reach_a_step_in_frames_of_bounded_size(spark, monkeypatch):
    from cohortloom.operators import gram as G

    monkeypatch.setattr(G, "STEP_BYTES", 40_000, raising=False)
    wide = spark.range(0, 600, 1, 2).selectExpr("cast(id as int) as k", "array(struct(transform(sequence(1, 100), x -> cast(x + id as double)) as _gram)) as parts")

    def step(pdf):
        return pd.DataFrame({"k": pdf["k"], "rows": np.int32(len(pdf)), "s": [float(np.sum(p[0]["_gram"])) if k else float("nan") for k, p in zip(pdf["k"], pdf["parts"])]})

    got = G.map_rows(wide, ["k"], step, "k int, rows int, s double" if not hasattr(G, "map_slices") else G.StructType.fromDDL("k int, rows int, s double")).collect()
    assert len(got) == 600 and max(r.rows for r in got) <= 50
    assert all(r.s == 5050 + 100 * r.k for r in got if r.k)
