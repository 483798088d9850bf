"""Spin assignment without a distance matrix, lookup by sorted merge, start of the shared response."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import nulls as N
from cohortloom.operators import srm as SR
from cohortloom.operators.axis import pack_rows
from cohortloom.operators.normative import interp_join
from cohortloom.operators.srm import shared_response


def plain_assign(points, turned):
    d = np.linalg.norm(points[:, None] - turned[None], axis=2)
    out = np.full(len(points), -1)
    for _ in range(len(points)):
        near = np.where(out < 0, d.min(axis=1), -np.inf)
        row = int(near.argmax())
        out[row] = hit = int(d[row].argmin())
        d[:, hit] = np.inf
    return out


def sphere(rng, n):
    p = rng.normal(size=(n, 3))
    return p / np.linalg.norm(p, axis=1)[:, None]


@pytest.mark.parametrize("cells", [7, 1 << 22])
def test_assignment_is_the_greedy_one(monkeypatch, cells):
    monkeypatch.setattr(N, "CELLS", cells)
    rng = np.random.default_rng(0)
    for n in (1, 2, 40, 180):
        points = sphere(rng, n)
        turned = points @ N._rotation(rng)
        assert N._assign(points, turned).tolist() == plain_assign(points, turned).tolist()


def test_spins_of_a_large_atlas(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "LR"[i % 2], *map(float, p)) for i, p in enumerate(sphere(rng, 3000))]
    cents = spark.createDataFrame(rows, "parcel int, hemi string, x double, y double, z double")
    spins = N.spin_permutations(cents, "parcel", "hemi", "L", "R", 3)
    by = spins.groupBy("rot").agg(F.count("*").alias("n"), F.countDistinct("src").alias("m"), F.sum((F.col("src") % 2 != F.col("parcel") % 2).cast("int")).alias("crossed")).collect()
    assert sorted((r.rot, r.n, r.m, r.crossed) for r in by) == [(i, 3000, 3000, 0) for i in range(3)]


def test_lookup_equals_interp(spark):
    rng = np.random.default_rng(2)
    grids = {"a": np.sort(rng.lognormal(0, 3, 60)) - 5, "b": np.sort(rng.normal(size=3)), "lone": np.array([2.0])}
    grid = [(k, float(x), float(np.sin(x))) for k, g in grids.items() for x in g]
    rows = [(k, i, float(v)) for k, g in grids.items() for i, v in enumerate(np.r_[rng.uniform(g.min() - 1, g.max() + 1, 80), g])]
    rows += [("a", 900, None), ("a", 901, float("nan")), ("none", 902, 1.0)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(5)
    made = spark.createDataFrame(grid, "k string, gx double, gy double").repartition(3)
    got = {(r.k, r.i): r.y_grid for r in interp_join(df, made, ["k"], "v", "gx", "gy", 0.5).collect()}
    want = {}
    for k, i, v in rows:
        if k in grids and v is not None and not np.isnan(v) and grids[k].min() - 0.5 <= v <= grids[k].max() + 0.5:
            want[k, i] = np.interp(v, grids[k], np.sin(grids[k]))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_lookup_on_a_long_grid(spark):
    grid = spark.range(300_000).select((F.col("id") / 100).alias("gx"), (F.col("id") * 2.0).alias("gy"))
    df = spark.range(1000).select((F.col("id") * 2.9 + 0.003).alias("v"))
    off = interp_join(df, grid, [], "v", "gx", "gy", 0.5).select(F.max(F.abs(F.col("y_grid") - F.col("v") * 200)).alias("e"), F.count("*").alias("n")).first()
    assert off.n == 1000 and off.e < 1e-6


def test_shared_response_does_not_depend_on_the_order_of_parcels(spark):
    rng = np.random.default_rng(3)
    course = rng.normal(size=(30, 2))
    rows = [(s, t, p, float(course[t] @ w[p] + 0.1 * rng.normal())) for s in "abc" for w in [rng.normal(size=(5, 2))] for t in range(30) for p in range(5)]
    long = spark.createDataFrame(rows, "subject string, t int, parcel int, y double")
    fitted = {}
    for order in ([0, 1, 2, 3, 4], [3, 0, 4, 2, 1]):
        vec = pack_rows(long, ["subject", "t"], "parcel", "y", order)
        _, _, out = shared_response(vec, "subject", "t", 5, 2, n_iter=3)
        fitted[tuple(order)] = {(r.subject, r.t, p): v for r in out.collect() for p, v in zip(order, r.fitted, strict=True)}
    one, other = fitted.values()
    assert max(abs(one[k] - other[k]) for k in one) < 1e-6


def test_shared_response_of_subjects_with_gaps_moves_bases_only(spark, monkeypatch):
    monkeypatch.setattr(SR, "SPAN", 8)
    monkeypatch.setattr(SR, "SPAN_CELLS", 40, raising=False)
    rng = np.random.default_rng(4)
    x = {s: rng.normal(size=(30, 5)) + np.outer(np.sin(np.arange(30)), np.arange(5)) for s in "abcd"}
    seen = {s: [t for t in range(30) if s == "a" or (t * 7 + ord(s)) % 5] for s in x}
    rows = [(s, t, x[s][t].tolist()) for s in x for t in seen[s]]
    bases, shared, fitted = shared_response(spark.createDataFrame(rows, "subject string, t int, vec array<double>"), "subject", "t", 5, 2, n_iter=2)
    plan = fitted._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "InMemoryTableScan" in plan
    course = {r.t: np.array(r.s) for r in shared.collect()}
    w = {r.subject: np.array(r.w).reshape(5, 2) for r in bases.collect()}
    for t in range(30):
        assert np.allclose(course[t], np.mean([x[s][t] @ w[s] for s in x if t in seen[s]], axis=0))
    got = {(r.subject, r.t): r.fitted for r in fitted.collect()}
    assert got.keys() == {(s, t) for s, t, _ in rows}
    assert all(np.allclose(v, w[s] @ course[t]) for (s, t), v in got.items())


def test_a_repeated_position_is_named(spark):
    df = spark.createDataFrame([("s", "f", 1.0), ("s", "f", 2.0), ("s", "g", 3.0)], "k string, feature string, value double")
    with pytest.raises(Exception, match="two values"):
        pack_rows(df, ["k"], "feature", "value", ["f", "g"]).collect()


def sent_to_all(df):
    """Lines of the plan below each broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    depth = [len(line) - len(line.lstrip(" :+-|")) for line in lines]
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((k for k in range(at + 1, len(lines)) if depth[k] <= depth[at]), len(lines))
            yield lines[at:end]


@pytest.mark.parametrize("rows", [3, 4096])
def test_permuted_outcomes_are_those_of_sorted_hashes(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(N, "RANGE_ROWS", rows, raising=False)
    path = str(tmp_path / "outcomes")
    spark.range(0, 300, 3).selectExpr("id", "cast(id * id as double) as y").write.parquet(path)
    df = spark.read.parquet(path)
    made = N.permuted_outcome(df, "id", "y", 4, 5)
    # Exploded rows, which Spark takes for few, are never sent to every task.
    assert not [part for part in sent_to_all(made) if any("explode" in line for line in part)]
    ids = list(range(0, 300, 3))
    draw = lambda i, p: int(hashlib.md5(f"{i}:{p}:5".encode()).hexdigest()[:15], 16)
    want = {(p, i): float(j * j) for p in range(4) for i, j in zip(ids, sorted(ids, key=lambda k: (draw(k, p), k)))}
    assert {(r.perm, r.id): r.y for r in made.collect()} == want
