"""Label hierarchy on customers: the parent of a key is the key without its last digit, so the tree
grows with the table. Also gaze weighting, with events as gaze samples and order lines as pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortloom.operators import gaze as G
from cohortloom.operators import hierarchy as H
from cohortloom.plans.catalog import R, query, rounded, table


def edges(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("child"))
    return c.filter("child > 0").withColumn("parent", F.floor(F.col("child") / 10))


_ANC = (
    "edge AS (SELECT c_custkey AS child, c_custkey // 10 AS parent FROM customer WHERE c_custkey > 0), "
    "anc AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM edge UNION ALL SELECT a.node, e.parent, a.depth + 1 FROM anc a JOIN edge e ON a.ancestor = e.child)"
)
_VOC = "voc AS (SELECT c_custkey AS label FROM customer WHERE c_acctbal > 0)"
# Weight of a label per subject (= market segment of its orders' status).
_REG = "reg AS (SELECT o_orderstatus AS subject, o_custkey AS label, sum(CASE WHEN o_totalprice > 250000 THEN o_totalprice / 77777.7::DOUBLE ELSE 0 END) AS x FROM orders GROUP BY 1, 2)"


def vocabulary(spark, sf):
    return table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("label"))


def label_weights(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("subject"), F.col("o_custkey").alias("label"), "o_totalprice")
    x = F.when(F.col("o_totalprice") > 250000, F.col("o_totalprice") / 77777.7).otherwise(0.0)
    return o.groupBy("subject", "label").agg(F.sum(x).alias("x"))


@query("ancestors", "J9", f"WITH RECURSIVE {_ANC} SELECT node, ancestor, CAST(depth AS INTEGER) AS depth FROM anc")
def ancestors(spark, sf):
    return H.ancestors(edges(spark, sf))


@query("expand_hierarchy", "L1", f"WITH RECURSIVE {_ANC}, {_REG} SELECT subject, label, {R('x', 4)} AS x, FALSE AS is_copy FROM reg UNION ALL SELECT subject, ancestor, {R('x', 4)}, TRUE FROM reg JOIN anc ON node = label")
def expand_hierarchy(spark, sf):
    return rounded(H.expand_hierarchy(label_weights(spark, sf), H.ancestors(edges(spark, sf)), "label").select("subject", "label", "x", "is_copy"), 4)


@query(
    "merge_parents",
    "A13",
    f"WITH RECURSIVE {_ANC}, {_REG}, e AS (SELECT subject, label, x, 0 AS c FROM reg UNION ALL SELECT subject, ancestor, x, 1 FROM reg JOIN anc ON node = label), "
    "g AS (SELECT subject, label, sum(c) AS copies, coalesce(avg(nullif(x, 0)), 0) AS merged, max(x) FILTER (c = 0) AS own FROM e GROUP BY 1, 2) "
    f"SELECT subject, label, {R('CASE WHEN copies > 1 THEN merged ELSE own END', 4)} AS x FROM g WHERE copies > 1 OR own IS NOT NULL",
)
def merge_parents(spark, sf):
    e = H.expand_hierarchy(label_weights(spark, sf), H.ancestors(edges(spark, sf)), "label")
    return rounded(H.merge_parents(e, ["subject"], "label", "x"), 4)


@query("prune", "L2", f"WITH {_REG}, {_VOC} SELECT subject, label, {R('x', 4)} AS x FROM reg WHERE label IN (SELECT label FROM voc)")
def prune(spark, sf):
    return rounded(H.prune(label_weights(spark, sf), vocabulary(spark, sf), "label"), 4)


@query(
    "add_ancestors",
    "L3",
    f"WITH RECURSIVE {_ANC}, {_REG}, {_VOC}, up AS (SELECT node, ancestor FROM anc WHERE node IN (SELECT label FROM voc) AND ancestor IN (SELECT label FROM voc)) "
    f"SELECT r.subject, r.label, {R('max(r.x) + coalesce(sum(a.x), 0)', 4)} AS x FROM reg r LEFT JOIN up ON node = r.label LEFT JOIN reg a ON a.label = ancestor AND a.subject = r.subject GROUP BY 1, 2",
)
def add_ancestors(spark, sf):
    return rounded(H.add_ancestors(label_weights(spark, sf), H.ancestors(edges(spark, sf)), vocabulary(spark, sf), ["subject"], "label", "x"), 4)


@query(
    "label_edges",
    "L6",
    f"WITH RECURSIVE {_ANC}, {_VOC}, k AS (SELECT node, ancestor, depth, row_number() OVER (PARTITION BY node ORDER BY depth) AS rn FROM anc WHERE node IN (SELECT label FROM voc) AND ancestor IN (SELECT label FROM voc) AND ancestor IN (SELECT child FROM edge)) "
    "SELECT node, ancestor, CAST(depth AS INTEGER) AS steps FROM k WHERE rn = 1",
)
def label_edges(spark, sf):
    return H.label_edges(H.ancestors(edges(spark, sf)), vocabulary(spark, sf), "label")


@query(
    "regress_frequency",
    "L4",
    f"WITH {_REG}, f AS (SELECT o_custkey AS label, CAST(count(*) AS DOUBLE) AS f FROM orders GROUP BY 1), b AS (SELECT subject, sum(f * x) / sum(f * f) AS b FROM reg JOIN f USING (label) GROUP BY 1) "
    f"SELECT subject, label, {R('x - f * b', 4)} AS x FROM reg JOIN f USING (label) JOIN b USING (subject)",
)
def regress_frequency(spark, sf):
    freq = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("label")).agg(F.count("*").alias("freq"))
    return rounded(H.regress_frequency(label_weights(spark, sf), freq, ["subject"], "label", "x", "freq").select("subject", "label", "x"), 4)


@query(
    "weight_labels",
    "L5",
    f"WITH s AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'verb' ELSE 'noun_' || l_returnflag END AS label, l_discount AS mask_weight, l_tax AS x FROM lineitem) "
    f"SELECT l_orderkey, l_partkey, l_linenumber, label, {R('CASE WHEN label = $$verb$$ THEN 0.4 * x ELSE mask_weight END')} AS weighted FROM s".replace("$$", "'"),
)
def weight_labels(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "N", "verb").otherwise(F.concat(F.lit("noun_"), "l_returnflag")).alias("label"),
        F.col("l_discount").alias("mask_weight"), F.col("l_tax").alias("x"),
    )
    return rounded(H.weight_labels(li, "label", "mask_weight", "x", 0.4).select("l_orderkey", "l_partkey", "l_linenumber", "label", "weighted"))


@query("append_covariate", "L7", f"SELECT vec_id, len(embedding) + 2 AS width, {R('list_sum(embedding::DOUBLE[]) + label + vec_id', 4)} AS total FROM embeddings")
def append_covariate(spark, sf):
    e = table(spark, sf, "embeddings")
    v = H.append_covariate(F.col("embedding").cast("array<double>"), F.col("label"), F.col("vec_id"))
    d = e.select("vec_id", v.alias("v"))
    return rounded(d.select("vec_id", F.size("v").cast("bigint").alias("width"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total")), 4)


RADIUS, FACTOR = 15, 4.0
SCREEN = {"RU": (37 / 29, 20.5 / 16.5), "CBIC": (33.5 / 26.5, 26 / 15)}


def gaze_samples(spark, sf):
    """An event is one gaze sample; its frame is the order of the same number."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("user_id").alias("subject"), F.col("event_id").alias("frame"), (F.col("value") / 2).alias("gx"), (k * 2 - 100).alias("gy"), (F.lit(1.0) + k / 25).alias("unc"),
        F.when(F.col("user_id") % 2 == 0, "RU").otherwise("CBIC").alias("site"),
    )


def screens(spark, sf):
    """Screen scale of the sites that occur in the data."""
    sites = gaze_samples(spark, sf).select("site").distinct()
    pick = lambda i: F.when(F.col("site") == "RU", SCREEN["RU"][i]).otherwise(SCREEN["CBIC"][i])
    return sites.withColumn("sx", pick(0)).withColumn("sy", pick(1))


_GZ = (
    "g0 AS (SELECT user_id AS subject, event_id AS frame, value / 2 AS gx, CAST(props->>'$.k' AS DOUBLE) * 2 - 100 AS gy, 1.0 + CAST(props->>'$.k' AS DOUBLE) / 25 AS unc, user_id % 2 = 0 AS ru FROM events), "
    f"g1 AS (SELECT subject, frame, gx / 10 * CASE WHEN ru THEN {SCREEN['RU'][0]!r}::DOUBLE ELSE {SCREEN['CBIC'][0]!r}::DOUBLE END AS gx, gy / 10 * 1.2925::DOUBLE * -1 * CASE WHEN ru THEN {SCREEN['RU'][1]!r}::DOUBLE ELSE {SCREEN['CBIC'][1]!r}::DOUBLE END AS gy, unc FROM g0)"
)


@query("gaze_coordinates", "X1", f"WITH {_GZ} SELECT subject, frame, {R('gx')} AS gx, {R('gy')} AS gy FROM g1")
def gaze_coordinates(spark, sf):
    return rounded(G.to_screen(gaze_samples(spark, sf), screens(spark, sf), "site").select("subject", "frame", "gx", "gy"))


_KERNEL = " + ".join(f"exp(-{i * i} / (2 * s * s))" for i in np.arange(-RADIUS, RADIUS + 1).tolist())


@query(
    "gaze_weighted_presence",
    "J4 X2 A14 A15",
    f"WITH {_GZ}, b AS (SELECT quantile_cont(unc, 0.2) AS lo, quantile_cont(unc, 0.8) AS hi FROM g1), g AS (SELECT subject, frame, gx, gy, greatest(least(unc, hi), lo) * 4.0 AS s FROM g1, b), "
    f"k AS (SELECT *, {_KERNEL} AS axis FROM g), px AS (SELECT l_orderkey AS frame, l_returnflag AS label, CAST(l_quantity AS INTEGER) AS px, l_linenumber * 4 AS py FROM lineitem), "
    f"w AS (SELECT subject, k.frame, l.label, CASE WHEN px IS NULL THEN NULL WHEN pow(px - gx, 2) + pow(py - gy, 2) <= {RADIUS * RADIUS} THEN exp(-(pow(px - gx, 2) + pow(py - gy, 2)) / (2 * s * s)) / (axis * axis) ELSE 0 END AS w "
    "FROM k CROSS JOIN (VALUES ('A'), ('N'), ('R')) l(label) LEFT JOIN px ON px.frame = k.frame AND px.label = l.label) "
    f"SELECT subject, frame, label, coalesce({R('avg(w)', 7)}, 0.0) AS weight FROM w GROUP BY 1, 2, 3",
)
def gaze_weighted_presence(spark, sf):
    g = G.to_screen(gaze_samples(spark, sf), screens(spark, sf), "site").drop("site")
    px = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.col("l_returnflag").alias("label"), F.col("l_quantity").cast("int").alias("px"), (F.col("l_linenumber") * 4).alias("py")
    )
    return rounded(G.gaze_weighted_presence(G.clip_uncertainty(g), px, "frame", "subject", ["A", "N", "R"], FACTOR, RADIUS), 7)


@query(
    "gaze_per_frame",
    "A15",
    f"SELECT user_id AS subject, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600) AS INTEGER) AS frame, {R('quantile_cont(value / 2, 0.5)')} AS gx, {R('quantile_cont(CAST(props->>$$$.k$$ AS DOUBLE), 0.5)')} AS gy, {R('quantile_cont(value, 0.5)')} AS unc FROM events GROUP BY 1, 2".replace("$$$.k$$", "'$.k'"),
)
def gaze_per_frame(spark, sf):
    from cohortloom.plans.temporal_queries import hour

    e = table(spark, sf, "events").select(
        F.col("user_id").alias("subject"), hour().alias("frame"), (F.col("value") / 2).alias("gx"), F.get_json_object("props", "$.k").cast("double").alias("gy"), F.col("value").alias("unc")
    )
    return rounded(G.gaze_per_frame(e, ["subject", "frame"]))
