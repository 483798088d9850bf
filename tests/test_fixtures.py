"""Small fixtures with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions.small import unpack
from cohortloom.operators import atlas as A
from cohortloom.operators import axis as AX
from cohortloom.operators import cohort as C
from cohortloom.operators import dimension as D
from cohortloom.operators import gram as G
from cohortloom.operators import hierarchy as H
from cohortloom.operators import temporal as T
from cohortloom.operators.glm import glm_fdr, regress_out
from cohortloom.operators.harmonize import combat

RULES = C.QcRules("DX", ("TD", "ASD"), "cert", "by-history", "doc", "documentation provided", {"prep": 1, "remarks": "none", "rating": 1.0}, {"fd": 0.5})


def test_qc(frame):
    ok = ("TD", "rule-out", None, 1, "none", 0.1, 1.0)
    rows = [("pass", *ok)]
    for i, (name, v) in enumerate([(0, "other"), (3, 0), (4, "moved"), (5, 0.5), (6, 0.0)]):
        r = list(ok)
        r[name] = v
        rows.append((f"bad{i}", *r))
    rows.append(("history", "ASD", "by-history", None, 1, "none", 0.1, 1.0))
    rows.append(("documented", "ASD", "by-history", "documentation provided", 1, "none", 0.1, 1.0))
    rows.append(("missing", "TD", None, None, 1, "none", None, 1.0))
    df = frame(rows, "subject string, DX string, cert string, doc string, prep int, remarks string, fd double, rating double")
    assert sorted(r.subject for r in C.qc_cohort(df, RULES).collect()) == ["documented", "pass"]
    a = C.qc_audit(df, RULES).first()
    assert (a.n_rows, a.kept, a.rejected_history, a.rejected_fd, a.rejected_group) == (9, 2, 1, 2, 1)


def test_lag_heads_are_zero(frame):
    df = frame([("s", t, float(t + 1)) for t in range(5)], "s string, t int, x double")
    got = {r.t: (r.x, r.x_lag1, r.x_lag3) for r in T.lag_features(df, ["s"], "t", "x", (1, 3)).collect()}
    assert got == {0: (1, 0, 0), 1: (2, 1, 0), 2: (3, 2, 0), 3: (4, 3, 1), 4: (5, 4, 2)}


def test_folds_740(spark):
    df = T.assign_folds(spark.range(740).select(F.col("id").cast("int").alias("t")), "t", 740, T.STARTS_9)
    rows = df.collect()
    sizes = [sum(r.chunk == c for r in rows) for c in range(9)]
    assert sizes == [82, 82, 83, 82, 82, 83, 82, 82, 82]
    assert all(r.fold == r.chunk % 3 for r in rows)
    for f in range(3):
        assert sorted(r.pos for r in rows if r.fold == f) == list(range(sum(r.fold == f for r in rows)))
    assert T.chunk_starts(740, T.STARTS_16)[:5] == [0, 46, 92, 138, 185] and T.chunk_starts(740, T.STARTS_16)[-1] == 693 and T.chunk_starts(740, 2) == [0, 370]


def test_dominant_label_tie(frame):
    df = frame([(1, n) for n in (2, 1, 2, 1)] + [(2, 5)], "parcel int, network int")
    assert {r.parcel: r.network for r in A.dominant_label(df, "parcel", "network").collect()} == {1: 1, 2: 5}


def test_rollup_policies(frame):
    v = frame([(1, 2.0), (2, 4.0), (3, 9.0)], "parcel int, value double")
    atlas = frame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "parcel int, network string")
    mask = frame([(1,), (2,)], "parcel int")
    get = lambda **k: {r.network: r.value for r in A.rollup(v, atlas, "parcel", "network", "value", mask=mask, **k).collect()}
    assert get(policy="masked") == {"a": 3.0, "b": 0.0}
    assert get(policy="zero") == {"a": 2.0, "b": 0.0}
    assert get(policy="masked", how="sum") == {"a": 6.0, "b": 0.0}


def test_hierarchy(frame):
    hier = frame([("d", "c"), ("c", "b"), ("b", "a")], "child string, parent string")
    anc = H.ancestors(hier).cache()
    assert {(r.node, r.ancestor, r.depth) for r in anc.collect()} == {("d", "c", 1), ("d", "b", 2), ("d", "a", 3), ("c", "b", 1), ("c", "a", 2), ("b", "a", 1)}
    vocab = frame([("a",), ("c",), ("d",)], "label string")
    edges = {(r.node, r.ancestor) for r in H.label_edges(anc, vocab, "label", with_roots=True).collect()}
    assert edges == {("d", "c"), ("c", "a")}
    assert {(r.node, r.ancestor) for r in H.label_edges(anc, vocab, "label").collect()} == {("d", "c")}
    w = frame([("s", "a", 1.0), ("s", "c", 10.0), ("s", "d", 100.0)], "s string, label string, w double")
    assert {r.label: r.w for r in H.add_ancestors(w, anc, vocab, ["s"], "label", "w").collect()} == {"a": 1.0, "c": 11.0, "d": 111.0}


def test_hierarchy_cycle_is_an_error(frame):
    with pytest.raises(ValueError):
        H.ancestors(frame([("a", "b"), ("b", "a")], "child string, parent string"), max_rounds=3)


def test_merge_parents(frame):
    hier = frame([("x", "p"), ("y", "p"), ("z", "q")], "child string, parent string")
    reg = frame([(0, "x", 2.0), (0, "y", 0.0), (0, "z", 5.0), (1, "x", 0.0), (1, "y", 0.0), (1, "z", 1.0)], "t int, label string, v double")
    m = H.merge_parents(H.expand_hierarchy(reg, H.ancestors(hier), "label"), ["t"], "label", "v")
    got = {(r.t, r.label): r.v for r in m.collect()}
    assert got == {(0, "x"): 2.0, (0, "y"): 0.0, (0, "z"): 5.0, (0, "p"): 2.0, (1, "x"): 0.0, (1, "y"): 0.0, (1, "z"): 1.0, (1, "p"): 0.0}


def test_participation_ratio_of_independent_features(frame):
    x = np.kron(np.eye(6), [[1.0], [-1.0]]) * 3
    df = frame([("k", r.tolist()) for r in np.vstack([x] * 5)], "k string, v array<double>")
    for metric in ("cov",):
        assert D.participation_ratio(df, ["k"], "v", 6, metric).first().pr == pytest.approx(6.0)
    assert D.participation_ratio(df, ["k"], "v", 6, "cov", min_n=100).first().pr == 0.0


def test_similarity_metrics(frame):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5)) + 1
    df = frame([("k", r.tolist()) for r in x], "k string, v array<double>")
    norm = np.sqrt((x * x).sum(0))
    r = np.corrcoef(x.T)
    np.fill_diagonal(r, 0)
    want = {"cov": np.cov(x.T), "corr": np.arctanh(r), "cosine": x.T @ x / np.outer(norm, norm), "euc": np.sqrt(((x[:, :, None] - x[:, None, :]) ** 2).sum(0))}
    for metric, w in want.items():
        got = unpack(D.similarity(df, ["k"], "v", 5, metric).first().sim)
        assert np.allclose(got, w, atol=1e-6), metric
        e = np.linalg.eigvalsh(w)
        e = e[e > 0]
        assert D.participation_ratio(df, ["k"], "v", 5, metric).first().pr == pytest.approx(e.sum() ** 2 / (e * e).sum(), rel=1e-5)


@pytest.mark.parametrize("wide", [False, True])
def test_gram_folds(frame, wide):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 3))
    df = frame([(i // 5, *r.tolist(), r.tolist()) for i, r in enumerate(x)], "chunk int, a double, b double, c double, v array<double>")
    g = G.gram_wide(df, ["chunk"], "v", 3) if wide else G.gram_narrow(df, ["chunk"], ["a", "b", "c"])
    for r in G.complement(g, [], "chunk").collect():
        z = np.column_stack([np.ones(15), x[np.arange(20) // 5 != r.chunk]])
        assert np.allclose(unpack(r._gram), z.T @ z)


def test_wide_gram_in_segments(spark):
    """A matrix of several segments, over many tasks, with a hot key."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 100))
    k = np.where(np.arange(300) % 3 == 0, 0, np.arange(300) % 7 + 1)
    df = spark.createDataFrame([(int(a), r.tolist()) for a, r in zip(k, x)], "k int, v array<double>").repartition(13)
    for r in G.gram_wide(df, ["k"], "v", 100).collect():
        z = np.column_stack([np.ones((k == r.k).sum()), x[k == r.k]])
        assert np.allclose(unpack(r._gram), z.T @ z)


def test_pca_matches_numpy(frame):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.2])
    df = frame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>")
    comp = AX.pca(df, [], "v", 6, 3).orderBy("comp").collect()
    w, v = np.linalg.eigh(np.cov(x.T))
    assert np.allclose([c.eigenvalue for c in comp], w[::-1][:3])
    assert np.allclose([c.ratio for c in comp], w[::-1][:3] / w.sum())
    for c in comp:
        e = v[:, ::-1][:, c.comp - 1]
        e = e * np.sign(e[np.abs(e).argmax()])
        assert np.allclose(c.loading, e)
        s = {r.i: r.score for r in AX.pca_scores(df, AX.pca(df, [], "v", 6, 3), [], ["i"], "v").filter(F.col("comp") == c.comp).collect()}
        assert np.allclose([s[i] for i in range(60)], (x - x.mean(0)) @ e)


def test_sign_alignment_flips_and_settles(frame):
    rng = np.random.default_rng(6)
    ref = rng.normal(size=(50, 2))
    rows = [(s, p, c + 1, float(sg * ref[p, c] + 0.1 * rng.normal())) for s, sg in (("up", 1), ("down", -1), ("up2", 1)) for p in range(50) for c in range(2)]
    df = frame(rows, "subject string, parcel int, comp int, score double")
    r = frame([(p, c + 1, float(ref[p, c])) for p in range(50) for c in range(2)], "parcel int, comp int, score double")
    signs = AX.align_sign(df, r, "subject", "parcel")
    assert {(x.subject, x.sign) for x in signs.collect()} == {("up", 1.0), ("down", -1.0), ("up2", 1.0)}
    again = AX.align_sign(AX.apply_signs(df, signs, "subject"), r, "subject", "parcel")
    assert {x.sign for x in again.collect()} == {1.0}


def test_procrustes_recovers_rotation(frame):
    rng = np.random.default_rng(7)
    ref = rng.normal(size=(30, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    df = frame([("s", p, r.tolist()) for p, r in enumerate(ref @ q.T)], "subject string, parcel int, vec array<double>")
    r = frame([(p, v.tolist()) for p, v in enumerate(ref)], "parcel int, vec array<double>")
    got = np.array(AX.procrustes_rotation(df, r, "subject", "parcel", 3).first().rotation).reshape(3, 3)
    assert np.allclose(got, q, atol=1e-8)


def test_combat_removes_planted_shift(frame):
    rng = np.random.default_rng(8)
    rows = []
    for s in range(120):
        site, age = s % 2, float(rng.normal())
        for p in range(8):
            y = 0.5 * age + p + rng.normal() * (2.0 if site else 1.0) + (3.0 if site else 0.0)
            rows.append((s, "f", p, site, age, float(y)))
    df = frame(rows, "s int, feature string, parcel int, site int, age double, y double")
    out = combat(df, "feature", "parcel", "site", "y", ["age"]).toPandas()
    out["r"] = out["harmonised"] - 0.5 * out["age"]
    m = out.groupby(["parcel", "site"])["r"].agg(["mean", "std"]).unstack()
    assert (m["mean"][1] - m["mean"][0]).abs().max() < 0.35
    assert (m["std"][1] / m["std"][0]).between(0.8, 1.25).all()


def test_regress_out_matches_lstsq(frame):
    rng = np.random.default_rng(9)
    c = rng.normal(size=(50, 2))
    y = c @ [1.0, -2.0] + 4 + rng.normal(size=50)
    df = frame([(i, float(v), *map(float, r), float(T_)) for i, (v, r, T_) in enumerate(zip(y, c, np.linspace(-1, 1, 50)))], "i int, y double, a double, b double, tr double")
    got = {r.i: r.residual for r in regress_out(df, [], "y", ["a", "b"], t="tr").collect()}
    x = np.column_stack([np.ones(50), c, np.linspace(-1, 1, 50)])
    want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0] + y.mean()
    assert np.allclose([got[i] for i in range(50)], want)


def test_collapse_delays_tie_takes_first(frame):
    df = frame([("s", 3, 2.0), ("s", 5, -2.0), ("s", 7, 1.0)], "s string, d int, v double")
    assert AX.collapse_delays(df, ["s"], "d", "v", "max").first().v == 2.0
    assert AX.collapse_delays(df, ["s"], "d", "v", "mean").first().v == pytest.approx(1 / 3)


def test_planted_effect_is_found(spark):
    """60 subjects, 120 parcels, 30 of them shifted between the groups."""
    rng = np.random.default_rng(0)
    rows = []
    for s in range(60):
        age, site = float(rng.normal()), s % 2
        for p in range(120):
            shift = 1.3 * (s % 3 == 0) * (1 if p < 15 else -1) if p < 30 else 0.0
            rows.append((s, p, int(s % 3 == 0), site, age, float(rng.normal() + 0.3 * age + 0.2 * site + shift)))
    df = spark.createDataFrame(rows, "s int, parcel int, g int, site int, age double, y double")
    got = {r.parcel: r.sig for r in glm_fdr(df, "parcel", "y", ["g", "site", "age"], "one", 0.025).collect()}
    assert sum(got[p] == (1 if p < 15 else -1) for p in range(30)) >= 27
    assert sum(got[p] != 0 for p in range(30, 120)) <= 4
