"""Waves of repetitions, exact tests without long arrays, packed triangles, keys that must be there."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions.tails import fisher_two_sided
from cohortloom.operators import predict as P
from cohortloom.operators.dimension import group_similarity
from cohortloom.operators.gram import triangle
from cohortloom.operators.nulls import _rotation
from cohortloom.operators.stats import chi_square
from cohortloom.operators.subtype import demographic_tests
from cohortloom.sources.tables import read_table


def brute_fisher(a, b, c, d):
    r1, r2, c1 = a + b, c + d, a + c
    p = {k: math.comb(r1, k) * math.comb(r2, c1 - k) / math.comb(r1 + r2, c1) for k in range(max(0, c1 - r2), min(r1, c1) + 1)}
    return min(1.0, sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)))


def test_fisher_equals_the_full_sum():
    rng = np.random.default_rng(5)
    for row in [*rng.integers(0, 30, (200, 4)).tolist(), [0, 0, 0, 0], [0, 5, 5, 0], [7, 0, 0, 7], [300, 200, 250, 260]]:
        assert fisher_two_sided(*[[v] for v in row])[0] == pytest.approx(brute_fisher(*row), rel=1e-6, abs=1e-12)


def test_fisher_of_huge_counts_is_quick():
    p = fisher_two_sided([10**8], [10**8], [10**8], [10**8 + 10**4])[0]
    z = 0.5 * 10**4 / math.sqrt(4 * 10**8 / 4)  # shift of a cell over half its spread
    assert 0 < p < 1 and abs(p - math.erfc(z / math.sqrt(2) / 1)) < 0.1


def test_triangle_positions(spark):
    for width in (1, 2, 7, 340):
        i, j = np.triu_indices(width)
        at = triangle("id", width)
        got = spark.range(len(i)).select("id", at[0].alias("i"), at[1].alias("j")).orderBy("id").toPandas()
        assert (got["i"] == i).all() and (got["j"] == j).all()


def test_group_similarity_is_the_mean_of_cells(spark):
    sims = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("a", [3.0, 2.0, 1.0]), (None, [5.0, 5.0, 5.0])], "k string, sim array<double>")
    assert group_similarity(sims, []).first().sim == [3.0, 3.0, 3.0]
    assert {r.k: r.sim for r in group_similarity(sims, ["k"]).collect()} == {"a": [2.0, 2.0, 2.0], None: [5.0, 5.0, 5.0]}


def test_chi_square_keeps_a_null_key(spark):
    rows = [(k, a, b) for k in ("x", None) for a, b in [(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 0)] * 3 + [(1, 1)] * 9]
    got = {r.k: r for r in chi_square(spark.createDataFrame(rows, "k string, a int, b int"), ["k"], "a", "b").collect()}
    assert set(got) == {"x", None} and got["x"].chi2 == pytest.approx(got[None].chi2) and got["x"].df == 1
    assert got["x"].chi2 == pytest.approx(20 * (6 * 9 - 2 * 3) ** 2 / (8 * 12 * 9 * 11))


def test_two_clusters_use_the_exact_test(spark):
    rows = [(c, 10.0 + i + c, i % 3 == 0) for c in (0, 1) for i in range(9 - c)]
    got = {r.test: r for r in demographic_tests(spark.createDataFrame(rows, "c int, age double, male boolean"), "c", "age", "male", pair=(0, 1)).collect()}
    assert got["sex"].p == pytest.approx(brute_fisher(3, 6, 3, 5))
    assert -10 < got["age"].stat < 10 and 0 < got["age"].p <= 1


LAY = P.Layout(("grp",), ("f1", "f2"), ("y",), {"a": ("f1",), "b": ("f2",)}, "grp", ())


def people(spark, effect):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        g = float(i % 2)
        rows.append((i, [g, effect * g + float(rng.normal()), effect * g + float(rng.normal()), float(rng.normal())]))
    return spark.createDataFrame(rows, "id long, vec array<double>")


def test_waves_stop_when_enough_qualify(spark):
    valid, selected = P.draw_repetitions(people(spark, 4.0), "id", LAY, 3, ["a", "b"], 1, 3)
    assert sorted(r.rep for r in valid.collect()) == [0, 1, 2]
    assert selected.count() == 9 and selected.filter(F.size("selected") < 2).count() == 0


def test_too_few_valid_repetitions_are_an_error(spark):
    with pytest.raises(RuntimeError, match="of 2 repetitions"):
        P.draw_repetitions(people(spark, 0.0), "id", LAY, 3, ["a", "b"], 1, 2, alpha=1e-6, most=2)


def test_later_waves_draw_what_a_long_run_draws(spark):
    ids = spark.range(40)
    long = {(r.id, r.rep): (r.fold, r.part) for r in P.repeat_folds(ids, "id", 4, 5).collect()}
    late = {(r.id, r.rep): (r.fold, r.part) for r in P.repeat_folds(ids, "id", 2, 5, first=2).collect()}
    assert late == {k: v for k, v in long.items() if k[1] >= 2}


def test_rotations_keep_lengths_and_orientation():
    rng = np.random.default_rng(3)
    for _ in range(20):
        q = _rotation(rng)
        assert np.allclose(q @ q.T, np.eye(3)) and np.linalg.det(q) == pytest.approx(1)


def test_rows_without_a_key_stay_or_stop_the_job(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string").write.parquet(path)
    assert read_table(spark, path).count() == 2
    with pytest.raises(Exception, match="a row without k"):
        read_table(spark, path, key="k").collect()
