"""Ranks and tests without sorting or pairing a whole group, against brute force on skewed data."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.functions import scalar as X
from cohortloom.operators import ordering as O
from cohortloom.operators import stats as S
from cohortloom.operators.axis import anchor_sign


@pytest.fixture(scope="module")
def skewed(spark):
    """One key and one value hold a third of the rows each."""
    rng = np.random.default_rng(3)
    n = 600
    k = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abc"), n))
    x = np.where(rng.random(n) < 0.35, 7.0, np.round(rng.normal(size=n) * 5, 1))
    y = np.round(x / 3 + rng.normal(size=n) * 2, 1)
    pdf = {"k": k.tolist(), "x": x.tolist(), "y": y.tolist()}
    return spark.createDataFrame(list(zip(*pdf.values())), "k string, x double, y double"), pdf


def groups(pdf):
    k, x, y = (np.array(pdf[c]) for c in "kxy")
    return {g: (x[k == g], y[k == g]) for g in np.unique(k)}


def avg_rank(v):
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def test_rank_table(skewed):
    df, pdf = skewed
    got = {(r.k, r.x): (r._avg_rank, r._total) for r in O.rank_table(df, ["k"], "x").collect()}
    for g, (x, _) in groups(pdf).items():
        for v, r in zip(x, avg_rank(x)):
            assert got[g, v] == (r, len(x))


def test_percentiles(skewed):
    df, pdf = skewed
    got = {r.k: (r.a, r.b) for r in O.percentiles(df, ["k"], "x", {"a": 0.2, "b": 0.9}).collect()}
    for g, (x, _) in groups(pdf).items():
        assert got[g] == pytest.approx((np.percentile(x, 20), np.percentile(x, 90)))


def test_spearman_kendall_jonckheere(skewed):
    df, pdf = skewed
    sp = {r.k: r.r for r in S.spearman(df, ["k"], "x", "y").collect()}
    kt = {r.k: r.tau for r in S.kendall(df, ["k"], "x", "y").collect()}
    jt = {r.k: r.j for r in S.jonckheere(df, ["k"], "x", "y").collect()}
    for g, (x, y) in groups(pdf).items():
        assert sp[g] == pytest.approx(np.corrcoef(avg_rank(x), avg_rank(y))[0, 1])
        sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        assert kt[g] == pytest.approx((sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum()))
        up = x[:, None] < x[None, :]
        assert jt[g] == pytest.approx((up * ((y[:, None] < y) + 0.5 * (y[:, None] == y))).sum())


def test_wilcoxon_statistic(skewed):
    df, pdf = skewed
    got = {r.k: (r.n, r.w_plus) for r in S.wilcoxon(df, ["k"], "y").collect()}
    for g, (_, y) in groups(pdf).items():
        d = y[y != 0]
        assert got[g] == (len(d), pytest.approx(avg_rank(np.abs(d))[d > 0].sum()))


def test_bh_fixture(frame):
    df = frame([(p,) for p in (0.01, 0.02, 0.03, 0.04, 0.5)] + [(None,)], "p double")
    for small in (False, True):
        got = {r.p: r.p_adj for r in S.bh(df, [], "p", small_family=small).collect()}
        assert got[None] is None
        assert [got[p] for p in (0.01, 0.02, 0.03, 0.04, 0.5)] == pytest.approx([0.05] * 4 + [0.5])


def test_bh_bucketed_equals_window(frame):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(400) ** 3, 3)
    df = frame([(i, "hot" if i % 3 else "cold", float(v)) for i, v in enumerate(p)], "i int, f string, p double")
    a = {r.i: r.p_adj for r in S.bh(df, ["f"], "p").collect()}
    b = {r.i: r.p_adj for r in S.bh(df, ["f"], "p", small_family=True).collect()}
    assert a == pytest.approx(b)
    order = sorted((v, a[i], i) for i, v in enumerate(p.tolist()) if i % 3)
    assert all(x[1] <= y[1] + 1e-15 for x, y in itertools.pairwise(order))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=2, max_size=60))
def test_order_bucket_is_monotone(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", O.order_bucket("v").alias("b"))
    rows = sorted((r.v, r.b) for r in df.collect())
    assert all(a[1] <= b[1] for a, b in itertools.pairwise(rows))


def test_two_sample_matches_glm(frame):
    from cohortloom.operators.glm import glm

    rng = np.random.default_rng(1)
    rows = [(p, i % 2, float(rng.normal() + (p * (i % 2)))) for p in range(4) for i in range(40)]
    df = frame(rows, "parcel int, g int, y double")
    a = {r.parcel: r for r in S.two_sample_t(df, ["parcel"], "g", 1, 0, "y").collect()}
    for r in glm(df, ["parcel"], "y", ["g"]).collect():
        assert r.t == pytest.approx(a[r.parcel].t)
        assert r.p == pytest.approx(a[r.parcel].p)


def test_flat_response_is_not_tested(frame):
    from cohortloom.operators.glm import glm_fdr

    df = frame([(0, i % 2, 0.0) for i in range(20)] + [(1, i % 2, i % 2 * 5.0 + i / 40) for i in range(20)], "parcel int, g int, y double")
    rows = {r.parcel: r for r in glm_fdr(df, "parcel", "y", ["g"], "one", 0.025).collect()}
    assert (rows[0].t, rows[0].p_adj, rows[0].sig, rows[0].tested) == (0.0, 1.0, 0, False)
    assert rows[1].sig == 1 and rows[1].p == pytest.approx(rows[1].p_adj)


def test_constant_input_correlation_is_null_or_zero(frame):
    df = frame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    r = df.agg(X.corr("x", "y").alias("a"), X.corr_or_zero("x", "y").alias("b")).first()
    assert r.a is None and r.b == 0.0


def test_top_fraction_and_best(frame):
    df = frame([(i, float(i)) for i in range(30)], "i int, v double")
    assert sorted(r.i for r in O.top_fraction(df, [], "v", 0.1).collect()) == [27, 28, 29]
    m = frame([("a", 1.0, 0.5), ("b", 2.0, 0.9)], "model string, aic double, cfi double")
    assert {r.measure: r.best_model for r in O.best_model(m, "model", ["aic"], ["cfi"]).collect()} == {"aic": "a", "cfi": "b"}


def test_averages_do_not_depend_on_the_order_of_rows(spark):
    rows = [0.1, 0.05, 0.04, 0.0, 0.07, 0.01, 0.06, 0.09, 0.0, 0.03, 0.08, 0.02] * 20
    exact = sum(round(v * 100) for v in rows) / 100 / len(rows)
    seen = set()
    for seed in range(6):
        some = [(0, float(v)) for v in np.random.default_rng(seed).permutation(rows)]
        seen.add(spark.createDataFrame(some, "g int, v double").repartition(seed + 1).groupBy("g").agg(X.exact_avg("v").alias("a")).first().a)
    assert seen == {exact}
    odd = spark.createDataFrame([(0, None), (1, float("nan")), (1, 1.0), (2, 1e300), (2, 0.0), (3, None), (3, 2.5)], "g int, v double")
    got = {r.g: r.a for r in odd.groupBy("g").agg(X.exact_avg("v").alias("a")).collect()}
    assert got[0] is None and math.isnan(got[1]) and got[2] == 5e299 and got[3] == 2.5


def test_a_missing_anchor_section_flips_nothing(spark):
    scores = spark.createDataFrame([(0, 1, -2.0), (1, 1, -1.0), (0, 2, -3.0)], "parcel int, comp int, score double")
    atlas = spark.createDataFrame([(0, 4), (1, 0)], "parcel int, section int")
    got = lambda at: {(r.parcel, r.comp): r.score for r in anchor_sign(scores, atlas, "parcel", "section", at).collect()}
    assert got(2) == {(0, 1): -2.0, (1, 1): -1.0, (0, 2): -3.0}
    assert got(4) == {(0, 1): 2.0, (1, 1): 1.0, (0, 2): -3.0}
