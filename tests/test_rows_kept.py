"""Draws differ between salts, and no operator loses rows to null keys, small groups or absent folds."""

import math

from pyspark.sql import functions as F

from cohortloom.functions.scalar import key_hash
from cohortloom.operators import predict
from cohortloom.operators.axis import dense
from cohortloom.operators.ordering import rank_table
from cohortloom.operators.stats import pearson
from cohortloom.operators.temporal import trim


def test_repetitions_are_different_draws(spark):
    ids = spark.range(100).withColumnRenamed("id", "row")
    folds = predict.repeat_folds(ids, "row", 40, 5).toPandas()
    seen, together = set(), []
    for _, g in folds.groupby("rep"):
        fold = g.sort_values("row").fold.to_numpy()
        mates = frozenset(map(tuple, (fold[:, None] == fold[None]).astype(int)))
        seen.add(mates)
        together.append(fold[:, None] == fold[None])
        assert sorted(g.groupby("fold").size()) == [20] * 5
    assert len(seen) == 40
    share = sum((a & b).sum() - 100 for a, b in zip(together, together[1:], strict=False)) / sum(a.sum() - 100 for a in together[1:])
    assert abs(share - 19 / 99) < 0.03


def test_no_permutation_is_a_rotation_of_another(spark):
    rows = spark.range(40).select("id", *[key_hash("id", s).alias(f"h{s}") for s in range(6)]).toPandas()
    orders = [rows.sort_values(f"h{s}").id.tolist() for s in range(6)]
    turned = {tuple(o[o.index(0) :] + o[: o.index(0)]) for o in orders}
    assert len(turned) == 6


def test_null_keys_and_values_that_are_no_numbers(frame):
    rows = frame([(None, 1, 1.0), (None, 2, 2.0), ("a", 1, 3.0), ("a", 2, math.nan), ("a", 3, math.inf)], "k string, t int, v double")
    assert {(r.k, r.t) for r in trim(rows, ["k"], "t", 1, 0).collect()} == {(None, 2), ("a", 2), ("a", 3)}
    assert {(r.k, r.v, r._total) for r in rank_table(rows, ["k"], "v").collect()} == {(None, 1.0, 2), (None, 2.0, 2), ("a", 3.0, 1)}


def test_two_pairs_keep_their_row(frame):
    got = pearson(frame([("a", 1.0, 2.0), ("a", 2.0, 5.0)], "k string, x double, y double"), ["k"], "x", "y").first()
    assert (got.n, round(got.r, 9), got.p) == (2, 1.0, 1.0)


def test_a_fold_without_rows_in_a_part_trains_on_the_whole_part(frame):
    cells = frame([(0, 0, 0, [1.0]), (0, 1, 0, [2.0]), (0, 0, 1, [4.0])], "rep int, fold int, part int, _gram array<double>")
    got = {(r.fold, r.part): r._gram[0] for r in predict.training_parts(cells).collect()}
    assert got == {(0, 0): 2.0, (1, 0): 1.0, (0, 1): 0.0, (1, 1): 4.0}


def test_a_complete_count_with_gaps_is_not_trusted(frame):
    rows = frame([(1, [(0, 10.0), (2, 30.0)])], "k int, e array<struct<_i:int,_v:double>>")
    assert rows.select(dense("e", 2).alias("v")).first().v == [10.0, 0.0]
    assert rows.select(dense("e", 3).alias("v"), F.lit(1)).first().v == [10.0, 0.0, 30.0]


def test_hourly_series_keep_every_event_and_spread_over_tasks(spark, tmp_path):
    from datetime import datetime, timedelta

    from cohortloom.plans.temporal_queries import HOURS, hourly
    from cohortloom.session import parallelism

    at = lambda h: None if h is None else datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [(1, 0, 2.0), (1, 0, 3.0), (1, 719, 1.0), (1, 720, 4.0), (1, -2, 5.0), (2, 3, None), (2, 900, None), (None, 7, 1.5), (3, None, 2.5), (3, None, 0.5)]
    spark.createDataFrame([(u, at(h), v) for u, h, v in rows], "user_id bigint, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    made = hourly(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= parallelism(made)
    want = {(u, t): 0.0 for u in (1, 2, 3, None) for t in range(HOURS)}
    want |= {(1, 0): 5.0, (1, 719): 1.0, (1, 720): 4.0, (1, -2): 5.0, (2, 900): None, (None, 7): 1.5, (3, None): 3.0}
    got = [(r.user_id, r.t, r.x) for r in made.collect()]
    assert len(got) == len(want) and {(u, t): x for u, t, x in got} == want


def test_slopes_of_few_keys_go_to_the_rows(spark):
    from cohortloom.plans.queries import REGISTRY

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = REGISTRY["regress_out"].run(spark, "/root/testdata/sf0.001")
        assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
