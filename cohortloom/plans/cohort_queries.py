"""Cohort selection, score joins and frequency tables on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import scalar as X
from cohortloom.operators import cohort as C
from cohortloom.operators.temporal import zscore
from cohortloom.plans.catalog import R, query, rounded, table

RULES = C.QcRules(
    group="c_mktsegment",
    groups=("BUILDING", "MACHINERY", "HOUSEHOLD"),
    certainty="o_orderstatus",
    uncertain="P",
    document="o_orderpriority",
    documented="1-URGENT",
    equal={"c_nationkey": 7},
    below={"o_totalprice": 400000.0},
)


def participants(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"))


_PART = "p AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)"
_HIST = "NOT (o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT')"
_GRP = "c_mktsegment IN ('BUILDING','MACHINERY','HOUSEHOLD')"


@query("qc_cohort", "F1", f"WITH {_PART} SELECT o_orderkey, c_custkey, c_mktsegment FROM p WHERE {_GRP} AND {_HIST} AND c_nationkey = 7 AND o_totalprice < 400000")
def qc_cohort(spark, sf):
    return C.qc_cohort(participants(spark, sf), RULES).select("o_orderkey", "c_custkey", "c_mktsegment")


@query(
    "qc_audit",
    "F2",
    f"WITH {_PART} SELECT count(*) AS n_rows, count(*) FILTER (NOT ({_GRP})) AS rejected_group, count(*) FILTER (NOT ({_HIST})) AS rejected_history, "
    "count(*) FILTER (c_nationkey <> 7) AS rejected_c_nationkey, count(*) FILTER (o_totalprice >= 400000) AS rejected_o_totalprice, "
    f"count(*) FILTER ({_GRP} AND {_HIST} AND c_nationkey = 7 AND o_totalprice < 400000) AS kept FROM p",
)
def qc_audit(spark, sf):
    return C.qc_audit(participants(spark, sf), RULES)


@query(
    "cohort_intersect",
    "F3",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 250000) "
    "AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 250000)",
)
def cohort_intersect(spark, sf):
    o = table(spark, sf, "orders").filter("o_totalprice < 250000").withColumnRenamed("o_custkey", "c_custkey")
    base = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    a = C.cohort_intersect(base, o.filter("o_orderstatus = 'F'"), "c_custkey")
    return C.cohort_intersect(a, o.filter("o_orderstatus = 'O'"), "c_custkey")


@query("complete_cases", "F4", "SELECT d.doc_id, quality, toxic, n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL AND toxic IS NOT NULL AND n_chars IS NOT NULL")
def complete_cases(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    return C.complete_cases(d, ["quality", "toxic", "n_chars"]).select("doc_id", "quality", "toxic", "n_chars")


_SEG = r"'^https?://[^/]+/[^/]+/([^/?#]+)'"


@query("reject_text", "F5", f"SELECT page_id, seg FROM (SELECT page_id, regexp_extract(url, {_SEG}, 1) AS seg FROM pages) WHERE seg = '' OR TRY_CAST(seg AS DOUBLE) IS NOT NULL")
def reject_text(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+/[^/]+/([^/?#]+)", 1).alias("seg"))
    p = p.withColumn("num", F.when(F.col("seg") != "", F.col("seg")))
    return C.reject_text(p, ["num"]).drop("num")


@query(
    "screen_bands",
    "F6",
    "WITH b AS (SELECT c_custkey, c_mktsegment, CAST(floor(c_acctbal / 250) AS BIGINT) AS band FROM customer), "
    "s AS (SELECT band FROM b GROUP BY band HAVING count(*) FILTER (c_mktsegment = 'BUILDING') < 5 OR count(*) FILTER (c_mktsegment = 'MACHINERY') < 5) "
    "SELECT * FROM b WHERE band NOT IN (SELECT band FROM s)",
)
def screen_bands(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 250).alias("band"))
    return C.screen_bands(c, "band", "c_mktsegment", ["BUILDING", "MACHINERY"], 5)


@query(
    "attach_scores",
    "J1",
    "WITH f AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, o_orderpriority FROM orders) "
    "SELECT c_custkey, o_totalprice AS price, TRY_CAST(o_orderpriority AS DOUBLE) AS prio FROM customer LEFT JOIN f ON o_custkey = c_custkey AND rn = 1",
)
def attach_scores(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("sub-"), F.col("c_custkey")).alias("subject"))
    s = table(spark, sf, "orders").select(
        F.concat(F.col("o_custkey"), F.lit(",assessment")).alias("key"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.col("o_orderpriority").alias("prio"),
        "o_orderkey",
    )
    return C.attach_scores(c, s, "subject", "key", ["price", "prio"], "o_orderkey").drop("subject")


@query(
    "attach_clusters",
    "J5",
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'control' ELSE coalesce(k, 'unassigned') END AS cluster FROM customer LEFT JOIN "
    "(SELECT o_custkey, CAST(max(o_orderkey) % 3 AS VARCHAR) AS k FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON o_custkey = c_custkey",
)
def attach_clusters(spark, sf):
    labels = table(spark, sf, "orders").filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.max("o_orderkey") % 3).alias("k"))
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return C.attach_clusters(c, labels, "c_custkey", "c_mktsegment", "BUILDING", "k").select("c_custkey", "cluster")


@query(
    "key_audit",
    "J6",
    "SELECT doc_id, 'missing' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL "
    "SELECT doc_id, 'unused' AS status FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
)
def key_audit(spark, sf):
    return C.key_audit(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query(
    "value_counts",
    "A6",
    "SELECT 'o_orderstatus' AS variable, o_orderstatus AS level, count(*) AS n FROM orders GROUP BY 2 UNION ALL "
    "SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2",
)
def value_counts(spark, sf):
    return C.value_counts(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


_SUBS = ["AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "shared_control_union",
    "U1",
    "SELECT c_custkey, c_mktsegment AS subset_id FROM customer WHERE c_mktsegment IN ('AUTOMOBILE','FURNITURE','HOUSEHOLD','MACHINERY') UNION ALL "
    "SELECT c_custkey, s FROM customer, (VALUES ('AUTOMOBILE'),('FURNITURE'),('HOUSEHOLD'),('MACHINERY')) t(s) WHERE c_mktsegment = 'BUILDING'",
)
def shared_control_union(spark, sf):
    c = table(spark, sf, "customer")
    return C.shared_control_union(c, "c_mktsegment", F.col("c_mktsegment") == "BUILDING", _SUBS).select("c_custkey", "subset_id")


@query(
    "subset_summary",
    "A7",
    "WITH u AS (SELECT *, c_mktsegment AS subset_id FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL "
    "SELECT customer.*, s FROM customer, (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment <> 'BUILDING') WHERE c_mktsegment = 'BUILDING') "
    "SELECT subset_id, count(*) AS n, count(*) FILTER (c_mktsegment = 'BUILDING') AS n_0, count(*) FILTER (c_mktsegment = subset_id) AS n_1, "
    f"{R('avg(c_acctbal)', 4)} AS mean_c_acctbal, {R('stddev_samp(c_acctbal)', 4)} AS sd_c_acctbal, {R('avg(c_nationkey)')} AS mean_c_nationkey, "
    f"{R('stddev_samp(c_nationkey)')} AS sd_c_nationkey, {R('avg((c_acctbal + c_nationkey) / 2)', 4)} AS mean_of_row_means FROM u WHERE subset_id IN ('AUTOMOBILE','FURNITURE','HOUSEHOLD','MACHINERY') GROUP BY 1",
)
def subset_summary(spark, sf):
    c = table(spark, sf, "customer")
    u = C.shared_control_union(c, "c_mktsegment", F.col("c_mktsegment") == "BUILDING", _SUBS)
    u = u.withColumn("role", F.when(F.col("c_mktsegment") == "BUILDING", "control").otherwise("case"))
    s = C.subset_summary(u, "subset_id", "role", ["control", "case"], ["c_acctbal", "c_nationkey"])
    return rounded(s, 6, mean_c_acctbal=4, sd_c_acctbal=4, mean_of_row_means=4)


@query("group_mean", "A5", f"SELECT l_returnflag, l_linenumber, {R('avg(l_extendedprice)', 4)} AS mean FROM lineitem GROUP BY 1, 2")
def group_mean(spark, sf):
    return rounded(C.group_mean(table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber"], "l_extendedprice"), 4)


@query("crosstab", "A11", "SELECT lang, count(*) FILTER (toxic = 0) AS n_0, count(*) FILTER (toxic = 1) AS n_1 FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def crosstab(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return C.crosstab(d, "lang", "toxic", [0, 1])


_Z = "z AS (SELECT l_returnflag, l_linenumber, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS zq, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS zx FROM lineitem)"


def z_lines(spark, sf):
    d = table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice")
    return zscore(zscore(d, [], "l_quantity", 0, "zq"), [], "l_extendedprice", 0, "zx")


@query(
    "outlier_prevalence",
    "A8 W5",
    f"WITH {_Z}, u AS (SELECT l_returnflag, 'zq' AS variable, zq AS z FROM z UNION ALL SELECT l_returnflag, 'zx', zx FROM z) "
    f"SELECT l_returnflag, variable, count(z) AS n, {R('avg(CASE WHEN abs(z) > 1.5 THEN 1.0 ELSE 0.0 END)')} AS prevalence FROM u GROUP BY 1, 2",
)
def outlier_prevalence(spark, sf):
    return rounded(C.outlier_prevalence(z_lines(spark, sf), ["zq", "zx"], 1.5, ["l_returnflag"]))


@query(
    "outlier_prevalence_by_band",
    "A9",
    "WITH z AS (SELECT p_size, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS z FROM part), "
    "b AS (SELECT CASE WHEN p_size >= -20 AND p_size <= 0 THEN 0 WHEN p_size > 0 AND p_size <= 10 THEN 1 WHEN p_size > 10 AND p_size <= 14 THEN 2 WHEN p_size > 14 AND p_size <= 18 THEN 3 WHEN p_size > 18 THEN 4 END AS band, z FROM z) "
    f"SELECT CAST(g.band AS INTEGER) AS band, 'z' AS variable, count(z) AS n, coalesce({R('avg(CASE WHEN abs(z) > 1.2 THEN 1.0 ELSE 0.0 END)')}, 0.0) AS prevalence FROM range(0, 5) g(band) LEFT JOIN b ON b.band = g.band GROUP BY 1, 2",
)
def outlier_prevalence_by_band(spark, sf):
    d = zscore(table(spark, sf, "part").select("p_size", "p_retailprice"), [], "p_retailprice", 0, "z")
    return rounded(C.outlier_prevalence_by_band(d, ["z"], 1.2, "p_size", [-20, 0, 10, 14, 18, None]))


@query(
    "category_prevalence",
    "A10",
    "WITH f AS (SELECT lang, CASE WHEN quality = 1 OR toxic = 1 THEN 1 ELSE 0 END AS any_flag, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS toxic_flag FROM documents LEFT JOIN labels USING (doc_id)) "
    f"SELECT lang, 'any_flag' AS category, count(*) AS n, CAST(sum(any_flag) AS BIGINT) AS n_flag, {R('avg(any_flag)')} AS prevalence FROM f GROUP BY 1 UNION ALL "
    f"SELECT lang, 'toxic_flag', count(*), CAST(sum(toxic_flag) AS BIGINT), {R('avg(toxic_flag)')} FROM f GROUP BY 1",
)
def category_prevalence(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return rounded(C.category_prevalence(d, {"any_flag": C.any_of(["quality", "toxic"]), "toxic_flag": C.any_of(["toxic"])}, ["lang"]))


@query(
    "age_bands",
    "X8 X9",
    "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'childhood' WHEN p_size <= 14 THEN 'early_adolescence' WHEN p_size <= 18 THEN 'middle_adolescence' ELSE 'late_adolescence' END AS band, "
    "CAST(p_type = 'PROMO' AS INTEGER) AS is_promo FROM part",
)
def age_bands(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.age_band("p_size").alias("band"), X.dummy("p_type", "PROMO").alias("is_promo"))


@query(
    "scalar_functions",
    "X3 X4 X5 X7 X10 X11 W10",
    f"SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_tax > 0 THEN {R('l_discount / l_tax')} ELSE 0.0 END AS ratio, "
    f"{R('sqrt(greatest(least(2 * l_discount / (1 + l_discount + 1e-12), 1.0), 0.0))')} AS ceiling, {R('atanh(l_discount)')} AS fisher, "
    f"{R('CASE WHEN l_quantity > 25 THEN l_tax / 2 ELSE 1 - l_tax / 2 END')} AS p_greater, {R('(-l_discount + l_tax) / 2')} AS averaged, "
    "CASE WHEN l_tax < 0.001 THEN '***' WHEN l_tax < 0.01 THEN '**' WHEN l_tax < 0.05 THEN '*' ELSE 'ns' END AS stars, greatest(least(l_quantity, 40.0), 10.0) AS clipped FROM lineitem",
)
def scalar_functions(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("stat", F.col("l_quantity") - 25)
    return rounded(
        d.select(
            "l_orderkey", "l_partkey", "l_linenumber",
            X.safe_divide("l_discount", "l_tax").alias("ratio"),
            X.spearman_brown("l_discount").alias("ceiling"),
            X.fisher_z("l_discount").alias("fisher"),
            X.directional_p("l_tax", "stat", "greater").alias("p_greater"),
            X.metric_average("l_discount", "l_tax").alias("averaged"),
            X.stars("l_tax").alias("stars"),
            X.clip("l_quantity", F.lit(10.0), F.lit(40.0)).alias("clipped"),
        )
    )


@query(
    "corr_or_zero",
    "X12",
    f"SELECT l_returnflag, {R('coalesce(corr(l_quantity, l_extendedprice), 0)')} AS r, 0.0::DOUBLE AS r_constant FROM lineitem GROUP BY 1",
)
def corr_or_zero(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("one", F.lit(1.0))
    return rounded(d.groupBy("l_returnflag").agg(X.corr_or_zero("l_quantity", "l_extendedprice").alias("r"), X.corr_or_zero("l_quantity", "one").alias("r_constant")))


@query("composite", "V8", f"SELECT d.doc_id, {R('(quality + toxic + n_chars / 1000.0) / 3')} AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def composite(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("kc")).join(table(spark, sf, "labels"), "doc_id", "left")
    return rounded(d.select("doc_id", X.row_mean(["quality", "toxic", "kc"]).alias("score")))
