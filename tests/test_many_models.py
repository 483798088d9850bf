"""Many models at once: k-means starts, dendrograms cut at every k, permuted outcomes as columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions.small import pack
from cohortloom.operators import cluster as CL
from cohortloom.operators import predict as P
from cohortloom.operators.nulls import permuted_outcome


def test_kmeans_finds_planted_groups_and_never_beats_plain_moves(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(40, 2)) * 0.2 + c for c in ((0, 0), (4, 0), (0, 4))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(900, None, 1.0)], "id int, a double, b double").repartition(5)
    labels, inertia = CL.kmeans_scan(df, "id", ["a", "b"], ks=(2, 3, 4), restarts=12)
    got = {(r.k, r.id): r.cluster for r in labels.collect()}
    assert len(got) == 3 * 120
    cost = {r.k: r.inertia for r in inertia.collect()}
    assert cost[2] > cost[3] > cost[4]
    by = np.array([got[3, i] for i in range(120)])
    assert all(len(set(by[a : a + 40])) == 1 for a in (0, 40, 80)) and len(set(by)) == 3
    for k in (2, 3, 4):
        c = np.array([got[k, i] for i in range(120)])
        centres = np.array([x[c == j].mean(axis=0) for j in range(k)])
        assert [tuple(v) for v in centres] == sorted(tuple(v) for v in centres)
        assert ((x[:, None] - centres) ** 2).sum(2).argmin(1).tolist() == c.tolist()
        assert cost[k] == pytest.approx(((x - centres[c]) ** 2).sum(), rel=1e-3)


def plain_ward(d, k):
    """Merges by the increase of the within sum, from points."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > k:
        def rise(a, b):
            both = a + b
            inside = lambda g: sum(d[i, j] ** 2 for i in g for j in g) / (2 * len(g))
            return inside(both) - inside(a) - inside(b)
        pairs = [(rise(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def test_one_dendrogram_gives_every_k(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(13, 3))
    d = np.sqrt(((points[:, None] - points) ** 2).sum(2))
    sims = spark.createDataFrame([("k", [float(v) for v in pack(d)])], "key string, sim array<double>")
    tree = CL.ward_tree(sims, ["key"], 13, distance=True)
    heights = [r.height for r in tree.orderBy("step").collect()]
    assert heights == sorted(heights) and tree.agg(F.max("size")).first()[0] == 13
    labels = CL.ward_scan(tree, ["key"], 13, range(2, 7))
    got = {}
    for r in labels.collect():
        got.setdefault((r.k, r.cluster), set()).add(r.f)
    for k in range(2, 7):
        assert {frozenset(v) for (q, _), v in got.items() if q == k} == plain_ward(d, k)
    sil = {(r.k, r.f): r.silhouette for r in CL.stored_silhouette(CL.distance_cells(sims, ["key"], 13, distance=True), labels, ["key"]).collect()}
    for k in (2, 5):
        c = np.zeros(13, int)
        for (q, j), members in got.items():
            if q == k:
                c[list(members)] = j
        for i in range(13):
            own = [d[i, j] for j in range(13) if j != i and c[j] == c[i]]
            far = min(np.mean([d[i, j] for j in range(13) if c[j] == o]) for o in set(c) - {c[i]})
            want = (far - np.mean(own)) / max(far, np.mean(own)) if own else 0.0
            assert sil[k, i] == pytest.approx(want)


def test_permuted_outcomes_are_fitted_as_columns(spark):
    rng = np.random.default_rng(2)
    layout = P.Layout(("age",), ("x0", "x1", "x2"), ("y",), {"all": ("x0", "x1", "x2")}, None, ("age",))
    x = rng.normal(size=(120, 4))
    y = x[:, 1] - 0.5 * x[:, 2] + 0.3 * x[:, 0] + rng.normal(size=120) * 0.5
    rows = spark.createDataFrame([(i, [*map(float, r), float(v)]) for i, (r, v) in enumerate(zip(x, y))], "id long, vec array<double>")
    folds = P.repeat_folds(rows, "id", 1, 3)
    outcome = rows.select("id", F.element_at("vec", -1).alias("y"))
    shuffled = permuted_outcome(outcome, "id", "y", 5, 3).unionByName(outcome.withColumn("perm", F.lit(-1)))
    cells = P.fold_table(rows, folds, "id", layout)
    blocks = P.outcome_blocks(rows, shuffled, "id", block=4)
    sums = P.outcome_sums(rows, folds.drop("rep"), blocks, "id", layout)
    got = {r.perm: r.r for r in P.permuted_scores(cells.drop("rep"), sums, layout, n_alphas=12).collect()}
    assert sorted(got) == [-1, 0, 1, 2, 3, 4]
    # One outcome after the other, through the rows.
    for perm in (-1, 0, 3):
        own = rows.join(shuffled.filter(F.col("perm") == perm), "id").select("id", F.concat(F.slice("vec", 1, 4), F.array("y")).alias("vec"))
        parts = P.training_parts(P.fold_table(own, folds, "id", layout))
        fits = P.enet_cv(parts, layout, n_alphas=12)
        metrics = P.cv_metrics(P.cv_predictions(own, folds, fits, "id"), ["rep"]).first()
        assert got[perm] == pytest.approx(metrics.r, abs=2e-3)
