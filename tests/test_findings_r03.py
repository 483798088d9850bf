"""Sums that stay where their rows are, block pairs that grow with the rows, blocks by their real size."""

import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import blocks as BL
from cohortloom.operators import cluster as CL
from cohortloom.operators import encode as E
from cohortloom.plans import encoding_queries as Q


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return sum("Exchange" in line and "Broadcast" not in line for line in plan.splitlines())


def test_boot_path_sends_rows_once_and_equals_the_path_of_sums(spark):
    rng = np.random.default_rng(6)
    # Subjects with gaps, one without any point of the last third, points outside the grid.
    rows = [(s, t, rng.normal(size=6).tolist()) for s in range(5) for t in range(-2, 95) if (t * 5 + s) % 7 and not (s == 3 and t >= 60)]
    df = spark.createDataFrame([*rows, (9, 3, None)], "subject int, t int, row array<double>")
    kw = dict(length=5, frac=4, n_boot=3, seed=1)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        made = E.boot_path(df, "subject", "t", 4, 6, 90, 9, alphas=[0.5, 20.0], **kw)
        assert exchanges(made) == 1
        key = lambda r: (r.subject, r.test_fold, r.boot, r.alpha_id, r.alpha)
        got = {key(r): r.scores for r in made.collect()}
        want = {key(r): r.scores for r in E.ridge_path(E.boot_grams(df, "subject", "t", 6, 90, 9, **kw), "subject", 4, [0.5, 20.0]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert got.keys() == want.keys() and len(got) > 50
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_series_hold_one_row_for_an_empty_month(spark):
    sf = "/root/testdata/sf0.001"
    reg, sig = Q.series(spark, sf)
    lines = Q.monthly(spark, sf)
    assert reg.count() == lines.select("subject", "l_returnflag", "t").distinct().count()
    assert sig.filter("y = 0 and parcel > 1").count() == 0


def plain_silhouette(v, lab):
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    out = []
    for i in range(len(v)):
        own = lab == lab[i]
        a = d[i, own].sum() / max(own.sum() - 1, 1)
        b = min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
        out.append((b - a) / max(a, b) if own.sum() > 1 and max(a, b) > 0 else 0.0)
    return out


def test_silhouettes_make_each_distance_once_for_all_labellings(spark):
    rng = np.random.default_rng(8)
    v = np.vstack([rng.normal(size=(60, 3)), rng.normal(size=(30, 3)) + 3, np.zeros((10, 3))])
    one, two = np.arange(100) % 3, np.r_[np.zeros(60), np.ones(30), np.full(10, 2)].astype(int)
    df = spark.createDataFrame([(i, r.tolist(), int(a), int(b)) for i, (r, a, b) in enumerate(zip(v, one, two))], "id long, v array<double>, a int, b int")
    for block_rows in (None, 9):
        got = {(r["name"], r.id): r for r in CL.silhouettes(df, "id", "v", {"a": F.col("a"), "b": F.col("b")}, block_rows).collect()}
        assert len(got) == 200
        for name, lab in (("a", one), ("b", two)):
            assert [got[name, i].label for i in range(100)] == lab.tolist()
            assert [got[name, i].silhouette for i in range(100)] == pytest.approx(plain_silhouette(v, lab), abs=1e-7)


def test_silhouette_sends_rows_a_fixed_number_of_times(spark):
    sent = {}
    for n in (20_000, 80_000):
        df = spark.range(n).select("id", F.array((F.col("id") % 7).cast("double")).alias("v"), (F.col("id") % 2).cast("int").alias("c"))
        plan = CL.silhouette(df, "id", "v", "c")._jdf.queryExecution().optimizedPlan().toString()
        sent[n] = {int(x) for x in re.findall(r"pmod\(xxhash64\([^)]*\), (\d+)\)", plan)}
    assert sent[20_000] == sent[80_000] == {CL.SIDE}


def test_kmeans_deals_rows_of_one_file_to_all_cores(spark, monkeypatch):
    monkeypatch.setattr(CL, "MODEL_ROWS", 10, raising=False)
    seen = []
    held = CL._model_seeds
    monkeypatch.setattr(CL, "_model_seeds", lambda data, *a: seen.append(data.rdd.getNumPartitions()) or held(data, *a))
    df = spark.createDataFrame([(i, float(i % 3) * 5 + i / 1000) for i in range(120)], "id int, x double").coalesce(1)
    labels, _ = CL.kmeans_scan(df, "id", ["x"], ks=(3,), restarts=4)
    assert seen == [spark.sparkContext.defaultParallelism]
    assert {(r.id % 3, r.cluster) for r in labels.collect()} == {(0, 0), (1, 1), (2, 2)}


def test_a_block_is_scored_in_slices_of_its_targets(monkeypatch):
    rng = np.random.default_rng(2)
    nt, size, each = 60, 4000, 3
    fold = np.arange(nt) // 20
    codes = [[f * each + k for f in range(3) if f != fold[t] for k in (0, 1 + t % 2)] for t in range(nt)]
    rows = [{"t": t, "fold": fold[t], "codes": codes[t], "x": rng.normal(size=2), "w": None} for t in range(nt)]
    spectra = [{"test_fold": f, "boot": b, "mean": np.zeros(2), "inv": np.ones(2), "w": np.array([3.0, 9.0]), "q": np.eye(2).ravel()} for f in range(3) for b in range(2)]
    left = pd.DataFrame({"t": np.tile(np.arange(nt), size), "pos": np.repeat(np.arange(size), nt), "size": size, "y": rng.normal(size=nt * size)})
    me = BL._Subject(pd.DataFrame(rows + spectra))
    found, peak = [], []
    for limit in (64 << 20, 8 * nt * 300):
        monkeypatch.setattr(BL, "SLICE_BYTES", limit)
        tracemalloc.start()
        found.append(BL._block_scores(me, left, np.array([1.0, 50.0]), each))
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert set(found[0]) == {0, 1, 2} and np.abs(found[0][1]).max() > 0.1
    assert all(np.allclose(found[0][f], found[1][f]) for f in range(3))
    assert peak[1] < peak[0] / 2
