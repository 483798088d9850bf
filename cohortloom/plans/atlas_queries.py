"""Parcel maps on parts: a part is a parcel, its lines are vertices, networks are nations or brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import scalar as X
from cohortloom.operators import atlas as A
from cohortloom.operators.cohort import group_mean
from cohortloom.plans.catalog import R, emb_long, EMB, query, rounded, table


def supplied(spark, sf):
    """Lines with the supplier's nation: vertex -> (parcel = part, network = nation)."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_discount")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("network"))
    return li.join(s, "l_suppkey").withColumnRenamed("l_partkey", "parcel")


_SUP = "v AS (SELECT l_partkey AS parcel, s_nationkey AS network, l_extendedprice, l_returnflag, l_discount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
_DOM = "dom AS (SELECT parcel, network, n FROM (SELECT parcel, network, count(*) AS n, row_number() OVER (PARTITION BY parcel ORDER BY count(*) DESC, network) AS rn FROM v GROUP BY 1, 2) WHERE rn = 1)"
_VAL = "val AS (SELECT l_partkey AS parcel, avg(l_discount) AS value FROM lineitem GROUP BY 1)"
# A parcel is in the mask if its mean price is above 50000.
_MASK = "mask AS (SELECT l_partkey AS parcel FROM lineitem GROUP BY 1 HAVING avg(l_extendedprice) > 50000)"


def dominant(spark, sf):
    return A.dominant_label(supplied(spark, sf), "parcel", "network")


def parcel_map(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("parcel"), "l_discount")
    return group_mean(li, ["parcel"], "l_discount", "value")


def price_mask(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("parcel"), "l_extendedprice")
    return group_mean(li, ["parcel"], "l_extendedprice").filter("mean > 50000").select("parcel")


@query("dominant_network", "A1", f"WITH {_SUP}, {_DOM} SELECT * FROM dom")
def dominant_network(spark, sf):
    return dominant(spark, sf)


@query(
    "parcellate",
    "A2",
    f"SELECT p_brand, CAST(year(l_shipdate) AS INTEGER) AS t, {R('avg(l_extendedprice)', 3)} AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 5 GROUP BY 1, 2",
)
def parcellate(spark, sf):
    sig = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.year("l_shipdate").alias("t"), "l_extendedprice")
    return rounded(A.parcellate(sig, table(spark, sf, "part"), "p_partkey", "p_brand", ["t"], "l_extendedprice", F.col("p_size") > 5), 3)


def _rollup_sql(policy, how):
    v = "v2 AS (SELECT parcel, value FROM val WHERE parcel IN (SELECT parcel FROM mask))"
    x = "coalesce(v2.value, 0)" if policy == "zero" else "v2.value"
    return (
        f"WITH {_SUP}, {_DOM}, {_VAL}, {_MASK}, {v} SELECT network, coalesce({R(f'{how}({x})')}, 0.0) AS value, count({x}) AS n "
        "FROM dom LEFT JOIN v2 USING (parcel) GROUP BY 1"
    )


def _rollup(spark, sf, policy, how):
    return rounded(A.rollup(parcel_map(spark, sf), dominant(spark, sf), "parcel", "network", "value", policy, how, price_mask(spark, sf)))


@query("rollup_masked", "A3a F7", _rollup_sql("masked", "avg"))
def rollup_masked(spark, sf):
    return _rollup(spark, sf, "masked", "avg")


@query("rollup_sum", "A3a", _rollup_sql("masked", "sum"))
def rollup_sum(spark, sf):
    return _rollup(spark, sf, "masked", "sum")


@query("rollup_zero", "A3b", _rollup_sql("zero", "avg"))
def rollup_zero(spark, sf):
    return _rollup(spark, sf, "zero", "avg")


@query(
    "mask_expand",
    "F7 F8",
    f"WITH {_VAL}, {_MASK} SELECT p_partkey AS parcel, coalesce(value, 0.0) AS t, coalesce(value, 1.0) AS p, value AS score FROM "
    f"(SELECT p_partkey, {R('value', 9)} AS value FROM part LEFT JOIN (SELECT * FROM val WHERE parcel IN (SELECT parcel FROM mask)) ON parcel = p_partkey)",
)
def mask_expand(spark, sf):
    m = A.restrict(rounded(parcel_map(spark, sf), 9), price_mask(spark, sf), "parcel")
    m = m.select("parcel", F.col("value").alias("t"), F.col("value").alias("p"), F.col("value").alias("score"))
    domain = table(spark, sf, "part").select(F.col("p_partkey").alias("parcel"))
    return A.expand(m, domain, ["parcel"], {"t": 0.0, "p": 1.0, "score": None})


_SETS = (
    "a AS (SELECT DISTINCT l_partkey AS parcel FROM lineitem WHERE l_discount > 0.09), b AS (SELECT DISTINCT l_partkey AS parcel FROM lineitem WHERE l_tax > 0.07)"
)


def _sets(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "parcel")
    return li.filter("l_discount > 0.09").select("parcel"), li.filter("l_tax > 0.07").select("parcel")


@query("mask_union", "U3", f"WITH {_SETS} SELECT parcel FROM a UNION SELECT parcel FROM b")
def mask_union(spark, sf):
    return A.mask_union(*_sets(spark, sf), "parcel")


@query("mask_except", "U5", f"WITH {_SETS} SELECT parcel FROM a EXCEPT SELECT parcel FROM b")
def mask_except(spark, sf):
    return A.mask_except(*_sets(spark, sf), "parcel")


@query("mask_intersect", "U6", f"WITH {_SETS} SELECT parcel FROM a INTERSECT SELECT parcel FROM b")
def mask_intersect(spark, sf):
    return A.mask_intersect(*_sets(spark, sf), "parcel")


@query("attach_network", "J2", f"WITH {_SUP}, {_DOM}, {_VAL} SELECT parcel, {R('value', 9)} AS value, network FROM val JOIN dom USING (parcel)")
def attach_network(spark, sf):
    return rounded(A.attach_network(parcel_map(spark, sf), dominant(spark, sf).select("parcel", "network"), "parcel"), 9)


@query(
    "pair_maps",
    "J11",
    f"WITH a AS (SELECT l_partkey AS parcel, avg(l_discount) AS va FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS parcel, avg(l_tax) AS vb FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) "
    f"SELECT parcel, {R('va')} AS va, {R('vb')} AS vb FROM a JOIN b USING (parcel) WHERE va <> 0 AND vb <> 0",
)
def pair_maps(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "parcel")
    a = group_mean(li.filter("l_returnflag = 'A'"), ["parcel"], "l_discount", "va")
    b = group_mean(li.filter("l_returnflag = 'R'"), ["parcel"], "l_tax", "vb")
    return rounded(A.pair_maps(a, b, "parcel", "va", "vb", drop_zero=True))


@query(
    "join_ratings",
    "J3 F11",
    f"WITH l AS (SELECT p_partkey, p_name || '.n.' || p_size AS label, p_retailprice AS loading FROM part), r AS (SELECT split_part(p_name, '.', 1) AS word, avg(p_size) AS rating FROM part WHERE p_name NOT LIKE 'red%' GROUP BY 1) "
    f"SELECT p_partkey, word, loading, {R('rating')} AS rating FROM l JOIN r ON split_part(label, '.', 1) = word",
)
def join_ratings(spark, sf):
    p = table(spark, sf, "part")
    lo = p.select("p_partkey", F.concat_ws(".n.", "p_name", F.col("p_size").cast("string")).alias("label"), F.col("p_retailprice").alias("loading"))
    ra = p.filter(~F.col("p_name").startswith("red")).groupBy(X.clean_label("p_name").alias("word")).agg(F.avg("p_size").alias("rating"))
    return rounded(A.join_ratings(lo, ra, X.clean_label("label"), "word").select("p_partkey", "word", "loading", "rating"))


@query("min_members", "F10", f"SELECT l_orderkey, count(*) AS n, CASE WHEN count(*) >= 5 THEN {R('avg(l_discount)')} ELSE 0.0 END AS value FROM lineitem GROUP BY 1")
def min_members(spark, sf):
    return rounded(A.min_members(table(spark, sf, "lineitem"), ["l_orderkey"], 5, "l_discount", 0.0))


@query(
    "weight_rescale",
    "X15 A14",
    f"WITH {EMB}, s AS (SELECT label, quantile_cont(abs(value), 0.9) AS q, avg(value) AS m, stddev_pop(value) AS sd FROM emb GROUP BY 1) "
    f"SELECT vec_id, parcel, {R('(value + q) / (2 * q)')} AS rescaled, {R('abs((value - m) / sd)')} AS abs_z FROM emb JOIN s USING (label)",
)
def weight_rescale(spark, sf):
    return rounded(A.weight_rescale(emb_long(spark, sf), ["label"], "value").select("vec_id", "parcel", "rescaled", "abs_z"))


# Two t maps over embedding cells: labels below 5 against the rest, and even against odd labels.
def t_maps(spark, sf):
    from cohortloom.operators.stats import two_sample_t

    e = emb_long(spark, sf)
    e = e.withColumn("g1", (F.col("label") < 5).cast("int")).withColumn("g2", (F.col("label") % 2).cast("int"))
    return (
        two_sample_t(e, ["parcel"], "g1", 1, 0, "value").select("parcel", "t", "p"),
        two_sample_t(e, ["parcel"], "g2", 1, 0, "value").select("parcel", "t", "p"),
    )


def t_map_sql(name, cond):
    from cohortloom.plans.catalog import t_tail_sql

    st = (
        f"{name}0 AS (SELECT parcel, count(*) FILTER ({cond}) AS n1, count(*) FILTER (NOT ({cond})) AS n2, avg(value) FILTER ({cond}) AS m1, avg(value) FILTER (NOT ({cond})) AS m2, "
        f"var_samp(value) FILTER ({cond}) AS v1, var_samp(value) FILTER (NOT ({cond})) AS v2 FROM emb GROUP BY 1), "
        f"{name}1 AS (SELECT parcel, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t, CAST(n1 + n2 - 2 AS DOUBLE) AS df FROM {name}0), "
    )
    return st + f"{name} AS (SELECT parcel, t, 2 * {t_tail_sql('t', 'df')} AS p FROM {name}1)"


TM = f"{EMB}, {t_map_sql('ta', 'label < 5')}, {t_map_sql('tb', 'label % 2 = 1')}"
_OV = "ov AS (SELECT parcel, ta.t AS t_a, tb.t AS t_b, ta.p AS p_a, tb.p AS p_b, CAST(sign(ta.t) * sign(tb.t) * (CASE WHEN ta.p < 0.3 AND tb.p < 0.3 THEN 1 ELSE 0 END) AS INTEGER) AS overlap FROM ta JOIN tb USING (parcel))"


@query("signed_overlap", "U2", f"WITH {TM}, {_OV} SELECT parcel, {R('t_a', 4)} AS t_a, {R('p_a', 4)} AS p_a, {R('t_b', 4)} AS t_b, {R('p_b', 4)} AS p_b, overlap FROM ov")
def signed_overlap(spark, sf):
    return rounded(A.signed_overlap(*t_maps(spark, sf), "parcel", 0.3), 4)


@query("overlap_counts", "U2", f"WITH {TM}, {_OV} SELECT count(*) FILTER (overlap > 0) AS concordant, count(*) FILTER (overlap < 0) AS discordant, count(*) AS n FROM ov")
def overlap_counts(spark, sf):
    return A.overlap_counts(A.signed_overlap(*t_maps(spark, sf), "parcel", 0.3))


def cell_atlas(spark, sf, name, expr):
    """Atlas over embedding cells derived from the data: the cell's section or network."""
    return emb_long(spark, sf).groupBy("parcel").agg(expr.alias(name))


# Network of a cell: how many of its values are positive, in ten classes; section: its rounded spread.
_NET = "net AS (SELECT parcel, CAST(floor(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) * 20) AS BIGINT) AS network FROM emb GROUP BY 1)"
_SEC = "sec AS (SELECT parcel, CAST(floor(stddev_pop(value) * 1000) AS BIGINT) % 5 AS section FROM emb GROUP BY 1)"


def networks(spark, sf):
    return cell_atlas(spark, sf, "network", F.floor(F.avg((F.col("value") > 0).cast("double")) * 20))


def sections(spark, sf):
    return cell_atlas(spark, sf, "section", F.floor(F.stddev_pop("value") * 1000) % 5)


@query(
    "overlap_table",
    "A4c",
    f"WITH {TM}, {_OV}, {_NET}, {_SEC} SELECT parcel, network, section, {R('t_a', 4)} AS t_a, {R('t_b', 4)} AS t_b, {R('(abs(t_a) + abs(t_b)) / 2', 4)} AS mean_abs_t FROM ov JOIN net USING (parcel) JOIN sec USING (parcel) WHERE overlap <> 0",
)
def overlap_table(spark, sf):
    o = A.overlap_table(A.signed_overlap(*t_maps(spark, sf), "parcel", 0.3), networks(spark, sf), sections(spark, sf), "parcel")
    return rounded(o.select("parcel", "network", "section", "t_a", "t_b", "mean_abs_t"), 4)


@query(
    "signed_rollup",
    "A3c D11",
    f"WITH {TM}, {_NET}, s AS (SELECT parcel, CASE WHEN p < 0.3 THEN sign(t) ELSE 0 END AS sig FROM ta) "
    "SELECT network, CAST(sum(greatest(sig, 0)) AS BIGINT) AS n_positive, CAST(sum(least(sig, 0)) AS BIGINT) AS n_negative FROM net LEFT JOIN s USING (parcel) GROUP BY 1",
)
def signed_rollup(spark, sf):
    sig = A.sig_map(t_maps(spark, sf)[0], "t", "p", 0.3)
    return A.signed_rollup(sig, networks(spark, sf), "parcel", "network", "sig")


_FAM = "fam AS (SELECT network, CASE WHEN network % 3 = 0 THEN 'sal' WHEN network % 3 = 1 THEN 'dmn' ELSE 'cen' END AS family FROM (SELECT DISTINCT network FROM net))"


def families(nets):
    return nets.select("network").distinct().withColumn("family", F.when(F.col("network") % 3 == 0, "sal").when(F.col("network") % 3 == 1, "dmn").otherwise("cen"))


@query(
    "network_scores",
    "A4",
    f"WITH {TM}, {_NET}, {_FAM}, s AS (SELECT parcel, family FROM ta JOIN net USING (parcel) JOIN fam USING (network) WHERE p < 0.3) "
    f"SELECT vec_id, {R('avg(value) FILTER (family = $$sal$$)')} AS sal, {R('avg(value) FILTER (family = $$dmn$$)')} AS dmn, {R('avg(value) FILTER (family = $$cen$$)')} AS cen FROM emb LEFT JOIN s USING (parcel) GROUP BY 1".replace("$$", "'"),
)
def network_scores(spark, sf):
    nets = networks(spark, sf)
    sig = A.sig_map(t_maps(spark, sf)[0], "t", "p", 0.3).join(nets, "parcel")
    return rounded(A.network_scores(emb_long(spark, sf), sig, families(nets), "vec_id", "parcel", "network", "family", ["sal", "dmn", "cen"], "value"))


@query(
    "network_values",
    "A4b A5",
    f"WITH {TM}, {_NET}, {_FAM}, m AS (SELECT parcel, label < 5 AS grp, avg(value) AS mean FROM emb GROUP BY 1, 2) "
    f"SELECT parcel, network, family, grp, {R('mean')} AS mean FROM m JOIN ta USING (parcel) JOIN net USING (parcel) JOIN fam USING (network) WHERE p < 0.3",
)
def network_values(spark, sf):
    nets = networks(spark, sf)
    sig = A.sig_map(t_maps(spark, sf)[0], "t", "p", 0.3).join(nets, "parcel")
    means = group_mean(emb_long(spark, sf).withColumn("grp", F.col("label") < 5), ["parcel", "grp"], "value")
    return rounded(A.network_values(means, sig, families(nets), "parcel", "network").select("parcel", "network", "family", "grp", "mean"))
