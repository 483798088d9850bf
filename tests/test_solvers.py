"""Solver-based operators recomputed with numpy on raw rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import cluster as CL
from cohortloom.operators import compare as M
from cohortloom.operators import encode as E
from cohortloom.operators import normative as V
from cohortloom.operators import nulls as N
from cohortloom.operators import paths as PA
from cohortloom.operators import predict as P
from cohortloom.operators import srm as SR
from cohortloom.operators import subtype as B
from cohortloom.operators.temporal import assign_folds

NT, NC, NX, NY = 90, 9, 4, 2


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(11)
    data, rows = {}, []
    for s in range(2):
        x = rng.normal(size=(NT, NX)) * [1, 2, 3, 4] + 1
        y = x[:, :NY] + 0.3 * x[:, 2:] + rng.normal(size=(NT, NY)) * 2
        data[s] = (x, y)
        rows += [(s, t, np.r_[x[t], y[t]].tolist()) for t in range(NT)]
    df = spark.createDataFrame(rows, "subject int, t int, row array<double>")
    fold = {r.t: (r.fold, r.pos) for r in assign_folds(spark.range(NT).select(F.col("id").cast("int").alias("t")), "t", NT, NC).collect()}
    return df, data, np.array([fold[t][0] for t in range(NT)]), np.array([fold[t][1] for t in range(NT)])


def z(a):
    return (a - a.mean(0)) / a.std(0)


def ridge(x, y, a):
    return np.linalg.solve(x.T @ x + a * np.eye(x.shape[1]), x.T @ y)


def test_design_packs_lags_and_parcels(frame):
    reg = frame([("s", "f", t, float(t + 1)) for t in range(4)] + [("s", "g", t, 10.0 * t) for t in range(4)], "subject string, feature string, t int, x double")
    sig = frame([("s", p, t, float(100 * p + t)) for p in (1, 2) for t in range(4)], "subject string, parcel int, t int, y double")
    got = {r.t: r.row for r in E.design(reg, sig, "subject", "t", ["f", "g"], [1, 2], [1, 2]).collect()}
    assert got[0] == [0, 0, 0, 0, 100, 200]
    assert got[3] == [3, 20, 2, 10, 103, 203]
    assert len(got) == 4


def test_ridge_path_matches_rows(series):
    df, data, fold, _ = series
    alphas = [0.5, 20.0]
    kw = dict(length=5, frac=4, n_boot=3, seed=1)
    grams = E.boot_grams(df, "subject", "t", NX + NY, NT, NC, **kw)
    got = {(r.subject, r.test_fold, r.boot, r.alpha_id): r.scores for r in E.ridge_path(grams, "subject", NX, alphas).collect()}
    held = {t: {(c // 4, c % 4 - 1) for c in codes} for t, _, codes in E.time_layout(NT, NC, 5, 4, 3, 1)}
    assert len(got) == 2 * 3 * 3 * 2
    for (s, f, b, a), scores in got.items():
        x, y = data[s]
        train = np.flatnonzero(fold != f)
        xz, yz = z(x[train]), z(y[train])
        out = np.array([(f, b) in held[t] for t in train])
        assert 0 < out.sum() < len(train)
        w = ridge(xz[~out], yz[~out], alphas[a])
        want = [np.corrcoef(xz[out] @ w[:, v], yz[out, v])[0, 1] for v in range(NY)]
        assert np.allclose(scores, want, atol=1e-8)


def test_alpha_choice_takes_first_best(frame):
    p = frame([("s", 0, b, i, a, s) for b in range(2) for i, (a, s) in enumerate([(1.0, [0.5, 0.1]), (10.0, [0.5, 0.4]), (100.0, [0.2, 0.4])])], "subject string, test_fold int, boot int, alpha_id int, alpha double, scores array<double>")
    tgt = {r.target: r.alpha for r in E.select_alpha(p, "subject", "target").collect()}
    assert tgt == {0: 1.0, 1: 10.0}
    assert E.select_alpha(p, "subject", "all").first().alpha == 10.0
    assert {r.target_group: r.alpha for r in E.select_alpha(p, "subject", "group", ["u", "v"]).collect()} == {"u": 1.0, "v": 10.0}
    assert E.pooled_alpha(p, "subject").first().alpha == 10.0


def test_refit_scores_ceiling_and_predictions(series, spark):
    df, data, fold, pos = series
    alpha = spark.createDataFrame([(7.0,)], "alpha double")
    fit = E.ridge_fit(E.fold_grams(df, "subject", "t", NX + NY, NT, NC, length=6), alpha, "subject", NX).cache()
    scores = {(r.subject, r.fold, r.target): r for r in E.fit_scores(fit, "subject").collect()}
    weights = {(r.subject, r.fold, r.target, r.feature_pos): r.weight for r in E.fit_weights(fit, "subject", NX).collect()}
    pred = {(r.subject, r.t, r.target): r.y_hat for r in E.predict(df, fit, "subject", "t", NX, NY, NT, NC).collect()}
    for s, (x, y) in data.items():
        for f in range(3):
            tr, te = fold != f, fold == f
            w = ridge(z(x[tr]), z(y[tr]), 7.0)
            zx, zy = z(x[te]), z(y[te])
            half = (pos[te] // 6) % 2
            recon = [zx @ ridge(zx[half == h], zy[half == h], 7.0) for h in (0, 1)]
            for v in range(NY):
                assert scores[s, f, v].r == pytest.approx(np.corrcoef(zx @ w[:, v], zy[:, v])[0, 1])
                rs = np.corrcoef(recon[0][:, v], recon[1][:, v])[0, 1]
                assert scores[s, f, v].ceiling == pytest.approx(np.sqrt(np.clip(2 * rs / (1 + rs), 0, 1)))
                assert all(weights[s, f, v, i] == pytest.approx(w[i, v]) for i in range(NX))
                got = [pred[s, t, v] for t in np.flatnonzero(te)]
                assert np.allclose(got, zx @ w[:, v])


def test_covariate_is_fitted_but_not_scored(series, spark):
    """The last feature takes part in the fit only."""
    df, data, fold, _ = series
    alpha = spark.createDataFrame([(7.0,)], "alpha double")
    fit = E.ridge_fit(E.fold_grams(df, "subject", "t", NX + NY, NT, NC), alpha, "subject", NX, n_scored=NX - 1)
    got = {(r.subject, r.fold, r.target): r.r for r in E.fit_scores(fit, "subject").collect()}
    x, y = data[0]
    w = ridge(z(x[fold != 1]), z(y[fold != 1]), 7.0)[: NX - 1]
    zx = z(x[fold == 1])[:, : NX - 1]
    assert got[0, 1, 0] == pytest.approx(np.corrcoef(zx @ w[:, 0], y[fold == 1, 0])[0, 1])


def test_shared_response_is_orthonormal_and_recovers_signal(frame):
    rng = np.random.default_rng(12)
    s = rng.normal(size=(700, 2))
    rows = []
    for sub in range(3):
        q, _ = np.linalg.qr(rng.normal(size=(5, 5)))
        x = s @ q[:2] + 0.05 * rng.normal(size=(700, 5))
        rows += [(sub, t, x[t].tolist()) for t in range(700)]
    df = frame(rows, "subject int, t int, vec array<double>")
    bases, _, fitted = SR.shared_response(df, "subject", "t", 5, 2, n_iter=6)
    for r in bases.collect():
        w = np.array(r.w).reshape(5, 2)
        assert np.allclose(w.T @ w, np.eye(2), atol=1e-8)
    got = {(r.subject, r.t): r.fitted for r in fitted.collect()}
    x = np.array([r[2] for r in rows])
    f = np.array([got[r[0], r[1]] for r in rows])
    assert ((x - f) ** 2).sum() < 0.1 * (x**2).sum()


def layout():
    return P.Layout(("grp", "age"), ("a0", "a1", "a2", "b0", "b1"), ("y",), {"combined": ("a0", "a1", "a2", "b0", "b1"), "a": ("a0", "a1", "a2"), "b": ("b0", "b1")}, "grp", ("age",))


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(13)
    n = 120
    x = rng.normal(size=(n, 5))
    grp, age = rng.integers(0, 2, n), rng.normal(size=n)
    x[:, 0] += grp
    y = x[:, 0] * 2 - x[:, 3] + age + rng.normal(size=n) * 0.5
    m = np.column_stack([grp, age, x, y])
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id int, vec array<double>"), m


def test_folds_are_balanced(people):
    df, _ = people
    f = P.repeat_folds(df, "id", 3, 4).toPandas()
    assert (f.groupby(["rep", "fold"]).size() == 30).all() and (f.groupby(["rep", "id"]).size() == 1).all()
    h = P.repeat_folds(df, "id", 2, 3, halves=True).toPandas()
    assert sorted(h.rep.unique()) == [0, 1, 2, 3] and (h.groupby("rep").size() == 60).all()


def test_elastic_net_reaches_its_optimum(people):
    df, m = people
    folds = P.repeat_folds(df, "id", 1, 4).cache()
    parts = P.training_parts(P.fold_table(df, folds, "id", layout()))
    fits = P.enet_cv(parts, layout(), n_alphas=25).cache()
    who = folds.toPandas().set_index("id").sort_index()
    for r in fits.collect():
        tr = (who.fold != r.fold).to_numpy()
        feats = {"combined": [2, 3, 4, 5, 6], "a": [2, 3, 4], "b": [5, 6]}[r.model]
        cov = np.column_stack([np.ones(tr.sum()), m[tr, 1]])
        res = lambda c: c - cov @ np.linalg.lstsq(cov, c, rcond=None)[0]
        x = np.column_stack([res(m[tr, j]) for j in feats])
        x /= x.std(0)
        y = res(m[tr, 7])
        full = np.column_stack([np.ones(len(m)), m])
        assert np.allclose((full @ np.array(r.outcome))[tr], y, atol=1e-8)
        w = np.linalg.lstsq(x, (full @ np.array(r.hat))[tr], rcond=None)[0]
        grad = x.T @ (y - x @ w) / tr.sum()
        live = np.abs(w) > 1e-9
        assert np.allclose(grad[live], r.alpha * (r.l1_ratio * np.sign(w[live]) + (1 - r.l1_ratio) * w[live]), atol=2e-3)
        assert (np.abs(grad[~live]) <= r.alpha * r.l1_ratio + 2e-3).all()
    met = {x.model: x.r for x in P.cv_metrics(P.cv_predictions(df, folds, fits, "id"), ["model"]).collect()}
    assert met["combined"] > met["b"] and met["combined"] > 0.8


def test_fold_selection_uses_training_rows(people):
    df, m = people
    folds = P.repeat_folds(df, "id", 2, 4).cache()
    sel = P.fold_select(P.training_parts(P.fold_table(df, folds, "id", layout())), layout(), alpha=0.05)
    assert all("a0" in r.selected for r in sel.collect())
    assert [r.rep for r in P.valid_repetitions(sel, layout(), ["a"], 1, 1).collect()] == [0]
    assert P.valid_repetitions(sel, layout(), ["a", "b"], 2, 1).count() == 0


def test_sharp_matches_dense_likelihood(frame):
    rng = np.random.default_rng(14)
    j = 12
    base = rng.normal(size=j) * 0.1
    a, b = 0.05 + base + rng.normal(size=j) * 0.1, 0.05 - base + rng.normal(size=j) * 0.1
    got = M.sharp_test(frame([("i", float(x), float(y)) for x, y in zip(a, b)], "item string, d_a double, d_b double"), ["item"]).first()
    d = np.r_[a, b]

    def loss(rho):
        m, c = np.full((j, j), rho), np.full((j, j), rho)
        np.fill_diagonal(m, 1)
        np.fill_diagonal(c, 0)
        s = np.block([[m, c], [c, m]])
        q = d @ np.linalg.solve(s, d) / (2 * j)
        return j * np.log(q) + 0.5 * np.linalg.slogdet(s)[1], q

    grid = np.linspace(-1 / (2 * j - 1) + 1e-4, 0.5 - 1e-4, 3001)
    rho = grid[np.argmin([loss(r)[0] for r in grid])]
    q = loss(rho)[1]
    assert got.rho == pytest.approx(rho, abs=5e-4)
    assert got.z == pytest.approx(d.mean() / np.sqrt(q * (1 / (2 * j) + (j - 1) / j * rho)), rel=5e-3)


def test_spin_permutations_are_permutations(frame):
    rng = np.random.default_rng(15)
    rows = []
    for h, name in enumerate("LR"):
        v = rng.normal(size=(12, 3))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        rows += [(name, i + 12 * h, *map(float, r)) for i, r in enumerate(v)]
    cents = frame(rows, "hemi string, parcel int, x double, y double, z double")
    p = N.spin_permutations(cents, "parcel", "hemi", "L", "R", 20, seed=3).toPandas()
    again = N.spin_permutations(cents, "parcel", "hemi", "L", "R", 20, seed=3).toPandas()
    key = ["rot", "parcel"]
    assert p.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    for _, g in p.groupby("rot"):
        assert sorted(g.src) == list(range(24)) and ((g.src < 12) == (g.parcel < 12)).all() and (g.src != g.parcel).any()


def test_spin_p_restricts_after_spinning(frame):
    maps = frame([(i, float(i), float(i % 3) if i < 5 else None) for i in range(6)], "parcel int, x double, y double")
    perm = frame([(0, i, (i + 1) % 6) for i in range(6)], "rot int, parcel int, src int")
    mask = frame([(i,) for i in range(5)], "parcel int")
    got = {r.side: r.r for r in N.spin_nulls(maps, perm, "parcel", "x", "y", mask).collect()}
    x, y = np.arange(6.0), np.array([0, 1, 2, 0, 1, np.nan])
    assert got[0] == pytest.approx(np.corrcoef(np.roll(x, -1)[:5], y[:5])[0, 1])
    keep = ~np.isnan(np.roll(y, -1)[:5])
    assert got[1] == pytest.approx(np.corrcoef(x[:5][keep], np.roll(y, -1)[:5][keep])[0, 1])


def test_p_from_nulls_conventions(frame):
    nulls = frame([(v,) for v in (-0.6, -0.5, 0.1, 0.5, None)], "r double")
    p = lambda r, two=False: N.p_from_nulls(nulls, frame([(r,)], "r double"), (), two).first().p
    assert p(0.5) == 0.0 and p(0.4) == 0.25 and p(-0.5) == 0.25 and p(0.5, True) == 0.75
    perm = N.permutation_p(nulls, frame([(0.0,)], "r double")).first()
    assert perm.p == pytest.approx(2 / 5) and perm.n_perm == 5


def test_permuted_outcome_keeps_values(frame):
    df = frame([(i, float(i * i)) for i in range(40)], "id int, y double")
    p = N.permuted_outcome(df, "id", "y", 3, 1).toPandas()
    for _, g in p.groupby("perm"):
        assert sorted(g.y) == [float(i * i) for i in range(40)] and sorted(g.id) == list(range(40))
    assert p[p.perm == 0].sort_values("id").y.tolist() != p[p.perm == 1].sort_values("id").y.tolist()


@pytest.fixture(scope="module")
def path_data(spark):
    rng = np.random.default_rng(16)
    n = 400
    sal = rng.normal(size=n)
    cen = 0.6 * sal + rng.normal(size=n)
    dmn = 0.4 * cen + 0.3 * sal + rng.normal(size=n)
    cog = -0.5 * dmn + rng.normal(size=n)
    srs = 0.7 * dmn + rng.normal(size=n)
    g = np.arange(n) % 2
    m = np.column_stack([sal, cen, dmn, cog, srs])
    return spark.createDataFrame([(int(a), *map(float, r)) for a, r in zip(g, m)], "g int, sal double, cen double, dmn double, cog double, srs double"), m, g


def test_path_fit_of_the_true_structure(path_data):
    df, m, _ = path_data
    cols = list(PA.VARIABLES)
    fit = {r.model: r for r in PA.path_fit(PA.covariance(df, [], cols), [], cols).collect()}
    assert fit["model1"].df == 5 and fit["model1"].chi2 < 15 and fit["model1"].cfi > 0.97
    assert fit["model1"].aic == min(r.aic for r in fit.values())
    # The likelihood ratio against the saturated model, equation by equation.
    s = np.cov(m.T, bias=True)
    res = lambda y, x: s[y, y] - s[y, x] @ np.linalg.solve(s[np.ix_(x, x)], s[x, y])
    chi = len(m) * (np.log(res(3, [2])) + np.log(res(4, [2])) - np.log(res(3, [0, 1, 2])) - np.log(res(4, [0, 1, 2, 3])))
    assert fit["model1"].chi2 == pytest.approx(chi)


def test_saturated_structure_fits_exactly(path_data):
    df, _, _ = path_data
    st = PA.Structure("full", (("cen", ("sal",)), ("dmn", ("sal", "cen"))))
    r = PA.path_fit(PA.covariance(df, [], ["sal", "cen", "dmn"]), [], ["sal", "cen", "dmn"], [st]).first()
    assert r.df == 0 and r.chi2 == pytest.approx(0, abs=1e-8) and r.srmr == pytest.approx(0, abs=1e-10) and r.p is None


def test_group_invariance(path_data):
    df, _, _ = path_data
    cols = list(PA.VARIABLES)
    same = PA.group_invariance(PA.covariance(df, ["g"], cols), "g", cols, PA.STRUCTURES[0]).first()
    assert same.df_diff == 5 and same.converged and same.p > 0.001
    apart = df.withColumn("cen", F.when(F.col("g") == 1, F.col("cen") - 1.5 * F.col("sal")).otherwise(F.col("cen")))
    assert PA.group_invariance(PA.covariance(apart, ["g"], cols), "g", cols, PA.STRUCTURES[0]).first().p < 1e-6


def test_normative_model_choice_and_bands(spark):
    rng = np.random.default_rng(17)
    age = rng.uniform(5, 20, 300)
    sex = rng.integers(0, 2, 300)
    line = 0.2 * age + sex + rng.normal(size=300) * 0.5
    bend = 0.05 * (age - 12) ** 2 + rng.normal(size=300) * 0.5
    df = spark.createDataFrame([(i, float(a), int(s), float(u), float(v)) for i, (a, s, u, v) in enumerate(zip(age, sex, line, bend))], "id int, age double, sex int, line double, bend double")
    model = V.normative_fit(df, ["line", "bend"], "age", "sex").cache()
    m = {r.variable: r for r in model.collect()}
    assert m["bend"].model == "nonlinear" and m["line"].model == "linear"
    x = np.column_stack([np.ones(300), age, sex])
    b = np.linalg.lstsq(x, line, rcond=None)[0]
    assert np.allclose(m["line"].coef[:3], b)
    assert m["line"].sigma == pytest.approx(np.sqrt(((line - x @ b) ** 2).sum() / 297))
    zs = V.deviation(df, model, ["id"], ["line", "bend"], "age", "sex").groupBy("variable").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s")).collect()
    assert all(abs(r.m) < 1e-6 and abs(r.s - 1) < 0.02 for r in zs)
    t = V.trajectory(model).filter("variable = 'line'").toPandas().sort_values("point")
    assert len(t) == 100 and t.age.iloc[0] == pytest.approx(age.min()) and t.age.iloc[-1] == pytest.approx(age.max())
    cov = m["line"].sigma ** 2 * np.linalg.inv(x.T @ x)
    g = np.array([1, t.age.iloc[10], 0])
    assert t.se.iloc[10] == pytest.approx(np.sqrt(g @ cov @ g))
    curve = V.trajectory(model).filter("variable = 'bend'").toPandas()
    assert np.abs(curve.mu - 0.05 * (curve.age - 12) ** 2).max() < 0.5


def test_interp_matches_numpy(frame):
    rng = np.random.default_rng(18)
    gx, gy = np.sort(rng.uniform(0, 10, 20)), rng.normal(size=20)
    x = np.r_[rng.uniform(-1, 11, 60), gx[0], gx[-1], gx[7]]
    grid = frame([(float(a), float(b)) for a, b in zip(gx, gy)], "gx double, gy double")
    got = {r.i: r.y_grid for r in V.interp_join(frame([(i, float(v)) for i, v in enumerate(x)], "i int, x double"), grid, [], "x", "gx", "gy", 0.5).collect()}
    keep = [i for i, v in enumerate(x) if gx[0] - 0.5 <= v <= gx[-1] + 0.5]
    assert sorted(got) == keep
    assert np.allclose([got[i] for i in keep], np.interp(x[keep], gx, gy))


def test_silhouette_in_blocks(frame):
    rng = np.random.default_rng(19)
    v = np.vstack([rng.normal(size=(30, 3)), rng.normal(size=(15, 3)) + 4, [[9.0, 9, 9]]])
    lab = np.r_[np.zeros(30), np.ones(15), 2].astype(int)
    df = frame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(v, lab))], "id int, v array<double>, c int")
    got = {r.id: r.silhouette for r in CL.silhouette(df, "id", "v", "c", block_rows=7).collect()}
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    for i in range(len(v)):
        own = lab == lab[i]
        if own.sum() == 1:
            assert got[i] == 0.0
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_ward_finds_planted_groups(frame):
    rng = np.random.default_rng(20)
    v = np.vstack([rng.normal(size=(5, 2)) * 0.1 + c for c in ((0, 0), (5, 0), (0, 5))])
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    df = frame([("k", d[np.triu_indices(15)].tolist())], "k string, sim array<double>")
    lab = [r.cluster for r in CL.ward(df, ["k"], 15, 3, distance=True).orderBy("f").collect()]
    assert lab == [0] * 5 + [1] * 5 + [2] * 5
    members = CL.cluster_members(CL.ward(df, ["k"], 15, 3, distance=True), ["k"], "f", "cluster").collect()
    assert sorted(m.members for m in members) == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10, 11, 12, 13, 14]]


def test_kmeans_relabels_by_centroid(frame):
    rng = np.random.default_rng(21)
    x = np.r_[rng.normal(size=40) + 6, rng.normal(size=20) - 6]
    df = frame([(i, float(v)) for i, v in enumerate(x)], "id int, x double")
    labels, inertia = CL.kmeans_scan(df, "id", ["x"], ks=(2,), restarts=2)
    got = {r.id: r.cluster for r in labels.collect()}
    assert [got[i] for i in range(60)] == [1] * 40 + [0] * 20
    assert inertia.first().inertia == pytest.approx(((x[:40] - x[:40].mean()) ** 2).sum() + ((x[40:] - x[40:].mean()) ** 2).sum())


def test_manova_and_tukey(frame):
    rng = np.random.default_rng(22)
    g = np.arange(60) % 3
    v = rng.normal(size=(60, 2)) + np.outer(g, [0.8, 0.0])
    df = frame([(f"g{c}", *map(float, r)) for c, r in zip(g, v)], "g string, a double, b double")
    got = B.manova(df, [], "g", ["a", "b"]).first()
    w = sum((v[g == c] - v[g == c].mean(0)).T @ (v[g == c] - v[g == c].mean(0)) for c in range(3))
    t = (v - v.mean(0)).T @ (v - v.mean(0))
    lam = np.linalg.det(w) / np.linalg.det(t)
    assert got.wilks == pytest.approx(lam)
    # Two outcomes: the approximation is exact, F = (1 - sqrt L) / sqrt L * (n - k - 1) / (k - 1).
    assert got.f == pytest.approx((1 - np.sqrt(lam)) / np.sqrt(lam) * (60 - 3 - 1) / 2)
    tests, pairs = B.item_tests_with_controls(df, "g", ["a", "b"])
    assert {r["item"] for r in tests.collect()} == {"a", "b"}
    big = {(r.group_a, r.group_b): r.p for r in pairs.collect() if r["item"] == "a"}
    assert len(big) == 3 and big["g0", "g2"] == min(big.values())


def test_corrected_t_and_trend(frame):
    rng = np.random.default_rng(23)
    d = rng.normal(size=30) + 0.4
    df = frame([("i", "combined_vs_a", "greater", float(v)) for v in d], "item string, pair string, alternative string, d double")
    r = M.corrected_t(df, ["item", "pair", "alternative"], 10).first()
    assert r.t == pytest.approx(d.mean() / np.sqrt((1 / 30 + 1 / 9) * d.var(ddof=1)))
    rows = frame([("combined_vs_a", float(v)) for v in (0.1, 0.2, 0.3, 0.4, 0.5)] + [("a_vs_b", float(v)) for v in (0.1, -0.2, 0.3, -0.4, 0.5)], "pair string, d double")
    t = {x.pair: x for x in M.cross_item_trend(rows, "pair", "d").collect()}
    assert t["combined_vs_a"].sign_p == pytest.approx(1 / 32) and t["combined_vs_a"].wilcoxon_p == pytest.approx(1 / 32)
    assert t["combined_vs_a"].sign_p_adj == pytest.approx(2 / 32)
    assert t["a_vs_b"].w_plus == 9.0


def test_gaze_weight_is_a_normalised_kernel(frame):
    from cohortloom.operators.gaze import gaze_weighted_presence

    gaze = frame([("s", 0, 0.0, 0.0, 1.5)], "subject string, frame int, gx double, gy double, unc double")
    px = frame([(0, "ball_n", i, j) for i in range(-6, 7) for j in range(-6, 7)], "frame int, label string, px int, py int")
    got = {r.label: r.weight for r in gaze_weighted_presence(gaze, px, "frame", "subject", ["ball_n", "cup_n"], 2.0, 6).collect()}
    k = np.exp(-(np.arange(-6, 7) ** 2) / (2 * 3.0**2))
    k /= k.sum()
    k2 = np.outer(k, k)
    i = np.arange(-6, 7)
    k2[(i[:, None] ** 2 + i**2) > 36] = 0
    assert got == {"ball_n": pytest.approx(k2.mean()), "cup_n": 0.0}


def test_results_by_configuration(spark, tmp_path):
    from cohortloom.sources import tables as S

    df = spark.createDataFrame([(1, 2.0)], "parcel int, t double")
    S.write_result(df, str(tmp_path / "r"), {"bias": "0.3"})
    assert S.read_result(spark, str(tmp_path / "r"), {"bias": "0.3"}).collect() == df.collect()
    with pytest.raises(LookupError):
        S.read_result(spark, str(tmp_path / "r"), {"bias": "0.4"})
    calls = []
    build = lambda: calls.append(1) or df
    for _ in range(2):
        assert S.materialize(spark, str(tmp_path / "m"), build).count() == 1
    assert len(calls) == 1
    S.materialize(spark, str(tmp_path / "m"), build, overwrite=True)
    assert len(calls) == 2
    S.write_csv(df, str(tmp_path / "c"))
    back = S.read_table(spark, str(tmp_path / "c"), "parcel int, t double", key="parcel", fmt="csv")
    assert back.collect() == df.collect()
