"""Statistical tests on lines, events, parts and embedding cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import tails
from cohortloom.operators import atlas as A
from cohortloom.operators import gram as GR
from cohortloom.operators import stats as S
from cohortloom.plans.atlas_queries import TM, t_maps
from cohortloom.plans.catalog import EMB, R, chi2_tail_sql, emb_long, f_tail_sql, query, rounded, t_tail_sql, table, z_tail_sql


def lines(spark, sf, *cols):
    return table(spark, sf, "lineitem").select(*cols)


def _r_p(r="r", n="n"):
    return f"2 * {t_tail_sql(f'({r} * sqrt(({n} - 2) / (1 - {r} * {r})))', f'CAST({n} - 2 AS DOUBLE)')}"


@query("pearson", "H1 D15", f"WITH g AS (SELECT l_suppkey, count(*) AS n, corr(l_discount, l_tax) AS r FROM lineitem GROUP BY 1) SELECT l_suppkey, n, {R('r')} AS r, {R(_r_p())} AS p FROM g")
def pearson(spark, sf):
    return rounded(S.pearson(lines(spark, sf, "l_suppkey", "l_discount", "l_tax"), ["l_suppkey"], "l_discount", "l_tax"))


@query(
    "point_biserial",
    "D15 H1",
    f"WITH g AS (SELECT l_returnflag, count(*) AS n, corr(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END, l_quantity) AS r FROM lineitem GROUP BY 1) SELECT l_returnflag, n, {R('r')} AS r, {R(_r_p())} AS p FROM g",
)
def point_biserial(spark, sf):
    d = lines(spark, sf, "l_returnflag", "l_discount", "l_quantity").withColumn("b", (F.col("l_discount") > 0.05).cast("int"))
    return rounded(S.pearson(d, ["l_returnflag"], "b", "l_quantity"))


_RANKS = (
    "r AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2.0 AS ry FROM s)"
)


@query(
    "spearman",
    "H2",
    f"WITH s AS (SELECT l_returnflag AS k, l_extendedprice AS x, l_discount AS y FROM lineitem), {_RANKS}, g AS (SELECT k AS l_returnflag, count(*) AS n, corr(rx, ry) AS r FROM r GROUP BY 1) SELECT l_returnflag, n, {R('r')} AS r, {R(_r_p(), 5)} AS p FROM g",
)
def spearman(spark, sf):
    return rounded(S.spearman(lines(spark, sf, "l_returnflag", "l_extendedprice", "l_discount"), ["l_returnflag"], "l_extendedprice", "l_discount"), 6, p=5)


_CELLS = "c AS (SELECT l_returnflag AS k, l_quantity AS x, l_discount AS y, CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY 1, 2, 3)"


@query(
    "kendall",
    "H3",
    f"WITH {_CELLS}, s AS (SELECT a.k, sum(a.c * b.c * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM c a JOIN c b ON a.k = b.k GROUP BY 1), "
    "tx AS (SELECT k, sum(t * (t - 1) / 2) AS n1, sum(t * (t - 1) * (t - 2)) AS x0, sum(t * (t - 1) * (2 * t + 5)) AS x1, sum(t) AS n FROM (SELECT k, x, sum(c) AS t FROM c GROUP BY 1, 2) GROUP BY 1), "
    "ty AS (SELECT k, sum(t * (t - 1) / 2) AS n2, sum(t * (t - 1) * (t - 2)) AS y0, sum(t * (t - 1) * (2 * t + 5)) AS y1 FROM (SELECT k, y, sum(c) AS t FROM c GROUP BY 1, 2) GROUP BY 1), "
    "q AS (SELECT k, n, s, n1, n2, n * (n - 1) AS m, (n * (n - 1) * (2 * n + 5) - x1 - y1) / 18 + 2 * n1 * n2 / (n * (n - 1)) + x0 * y0 / (9 * n * (n - 1) * (n - 2)) AS var FROM s JOIN tx USING (k) JOIN ty USING (k)) "
    f"SELECT k AS l_returnflag, CAST(n AS BIGINT) AS n, {R('s / sqrt((m / 2 - n1) * (m / 2 - n2))')} AS tau, {R('2 * ' + z_tail_sql('(abs(s) / sqrt(var))'), 5)} AS p FROM q",
)
def kendall(spark, sf):
    return rounded(S.kendall(lines(spark, sf, "l_returnflag", "l_quantity", "l_discount"), ["l_returnflag"], "l_quantity", "l_discount"), 6, p=5)


_JT = (
    "j AS (SELECT a.k, sum(a.c * b.c * CASE WHEN b.y > a.y THEN 1.0 WHEN b.y = a.y THEN 0.5 ELSE 0 END) AS j FROM c a JOIN c b ON a.k = b.k AND a.x < b.x GROUP BY 1), "
    "n AS (SELECT k, sum(t) AS n, sum(t * t) AS sq, sum(t * t * (2 * t + 3)) AS cu FROM (SELECT k, x, sum(c) AS t FROM c GROUP BY 1, 2) GROUP BY 1), "
    "z AS (SELECT k, n, j, (j - (n * n - sq) / 4) / sqrt((n * n * (2 * n + 3) - cu) / 72) AS z FROM j JOIN n USING (k))"
)


@query(
    "jt_trend",
    "H5",
    f"WITH c AS (SELECT l_returnflag AS k, l_linenumber AS x, floor(l_extendedprice / 1000) AS y, CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY 1, 2, 3), {_JT} "
    f"SELECT k AS l_returnflag, CAST(n AS BIGINT) AS n, {R('j', 1)} AS j, {R('z', 5)} AS z, {R('CASE WHEN z > 0 THEN ' + z_tail_sql('z') + ' ELSE 1 - ' + z_tail_sql('z') + ' END', 5)} AS p_increasing, {R('2 * ' + z_tail_sql('z'), 5)} AS p_two_sided FROM z",
)
def jt_trend(spark, sf):
    d = lines(spark, sf, "l_returnflag", "l_linenumber", F.floor(F.col("l_extendedprice") / 1000).alias("y"))
    return rounded(S.jonckheere(d, ["l_returnflag"], "l_linenumber", "y"), 5, j=1)


@query(
    "simple_regression",
    "H4",
    f"WITH g AS (SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, corr(l_quantity, l_tax) AS r FROM lineitem GROUP BY 1) "
    f"SELECT l_returnflag, n, {R('slope', 4)} AS slope, {R('intercept', 3)} AS intercept FROM g",
)
def simple_regression(spark, sf):
    d = S.simple_regression(lines(spark, sf, "l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return rounded(d.select("l_returnflag", "n", "slope", "intercept"), 4, intercept=3)


@query(
    "paired_t",
    "H6 D8",
    f"WITH {EMB}, w AS (SELECT label, vec_id, CAST(parcel // 16 AS INTEGER) AS comp, avg(value) FILTER (parcel % 2 = 0) AS a, avg(value) FILTER (parcel % 2 = 1) AS b FROM emb GROUP BY 1, 2, 3), "
    "g AS (SELECT comp, count(*) AS n, avg(a - b) AS mean_diff, avg(a - b) / sqrt(var_samp(a - b) / count(*)) AS t FROM w GROUP BY 1), "
    f"p AS (SELECT *, 2 * {t_tail_sql('t', 'CAST(n - 1 AS DOUBLE)')} AS p FROM g) SELECT comp, n, {R('mean_diff')} AS mean_diff, {R('t', 5)} AS t, {R('p')} AS p, {R('least(p * 4, 1.0)')} AS p_adj FROM p",
)
def paired_t(spark, sf):
    e = emb_long(spark, sf).withColumn("comp", F.floor(F.col("parcel") / 16).cast("int"))
    v = lambda k: F.avg(F.when(F.col("parcel") % 2 == k, F.col("value")))
    w = e.groupBy("vec_id", "comp").agg(v(0).alias("a"), v(1).alias("b"))
    return rounded(S.bonferroni(S.paired_t(w, ["comp"], "a", "b"), [], "p"), 6, t=5)


@query(
    "pooled_t",
    "H6 P8",
    f"WITH g AS (SELECT l_linenumber, count(*) FILTER (l_returnflag = 'A') AS n1, count(*) FILTER (l_returnflag = 'R') AS n2, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS mean1, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS mean2, "
    "var_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS v1, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS v2 FROM lineitem GROUP BY 1), "
    "t AS (SELECT *, CAST(n1 + n2 - 2 AS DOUBLE) AS df, (mean1 - mean2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t FROM g) "
    f"SELECT l_linenumber, n1, n2, {R('mean1', 3)} AS mean1, {R('mean2', 3)} AS mean2, df, {R('t', 5)} AS t, {R('2 * ' + t_tail_sql('t', 'df'), 5)} AS p FROM t",
)
def pooled_t(spark, sf):
    d = lines(spark, sf, "l_linenumber", "l_returnflag", "l_extendedprice")
    return rounded(S.two_sample_t(d, ["l_linenumber"], "l_returnflag", "A", "R", "l_extendedprice"), 5, mean1=3, mean2=3)


@query(
    "welch_t",
    "H6",
    "WITH g AS (SELECT l_linenumber, count(*) FILTER (l_returnflag = 'A') AS n1, count(*) FILTER (l_returnflag = 'R') AS n2, avg(l_discount) FILTER (l_returnflag = 'A') AS mean1, avg(l_discount) FILTER (l_returnflag = 'R') AS mean2, "
    "var_samp(l_discount) FILTER (l_returnflag = 'A') AS v1, var_samp(l_discount) FILTER (l_returnflag = 'R') AS v2 FROM lineitem GROUP BY 1), "
    "t AS (SELECT *, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df, (mean1 - mean2) / sqrt(v1 / n1 + v2 / n2) AS t FROM g) "
    f"SELECT l_linenumber, n1, n2, {R('mean1')} AS mean1, {R('mean2')} AS mean2, {R('df', 3)} AS df, {R('t', 5)} AS t, {R('2 * ' + t_tail_sql('t', 'df'), 5)} AS p FROM t",
)
def welch_t(spark, sf):
    d = lines(spark, sf, "l_linenumber", "l_returnflag", "l_discount")
    return rounded(S.two_sample_t(d, ["l_linenumber"], "l_returnflag", "A", "R", "l_discount", welch=True), 6, df=3, t=5, p=5)


ANOVA = (
    "m AS (SELECT {key}, {g}, count(*) AS n, avg({v}) AS mu, var_pop({v}) AS vp FROM {t} GROUP BY 1, 2), "
    "s AS (SELECT {key}, CAST(sum(n) AS BIGINT) AS n_total, count(*) AS k, sum(n * mu * mu) - pow(sum(n * mu), 2) / sum(n) AS ss_between, sum(n * vp) AS ss_within FROM m GROUP BY 1), "
    "f AS (SELECT *, (ss_between / (k - 1)) / (ss_within / (n_total - k)) AS f FROM s)"
)


@query(
    "anova",
    "H7",
    f"WITH {ANOVA.format(key='l_linenumber', g='l_returnflag', v='l_discount', t='lineitem')} SELECT l_linenumber, n_total, k, {R('ss_between')} AS ss_between, {R('ss_within', 5)} AS ss_within, {R('f', 5)} AS f, {R(f_tail_sql('f', 'CAST(k - 1 AS DOUBLE)', 'CAST(n_total - k AS DOUBLE)'), 5)} AS p FROM f",
)
def anova(spark, sf):
    return rounded(S.anova(lines(spark, sf, "l_linenumber", "l_returnflag", "l_discount"), ["l_linenumber"], "l_returnflag", "l_discount"), 5, ss_between=6)


@query(
    "chi_square",
    "H8",
    "WITH o AS (SELECT l_linenumber AS k, l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2, 3), "
    "e AS (SELECT k, o, CAST(sum(o) OVER (PARTITION BY k, a) AS DOUBLE) * sum(o) OVER (PARTITION BY k, b) / sum(o) OVER (PARTITION BY k) AS e FROM o), "
    "d AS (SELECT k, count(DISTINCT a) AS ra, count(DISTINCT b) AS rb FROM o GROUP BY 1), c AS (SELECT k, CAST(sum(o) AS BIGINT) AS n, sum(pow(o - e, 2) / e) + sum(o) - sum(e) AS chi2 FROM e GROUP BY 1) "
    f"SELECT k AS l_linenumber, n, {R('chi2', 5)} AS chi2, (ra - 1) * (rb - 1) AS df, {R(chi2_tail_sql('chi2', 'CAST((ra - 1) * (rb - 1) AS DOUBLE)'), 5)} AS p FROM c JOIN d USING (k)",
)
def chi_square(spark, sf):
    return rounded(S.chi_square(lines(spark, sf, "l_linenumber", "l_returnflag", "l_linestatus"), ["l_linenumber"], "l_returnflag", "l_linestatus"), 5)


@query(
    "fisher_exact",
    "H8",
    "WITH s AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS n11, count(*) FILTER (quality = 1 AND toxic = 0) AS n10, count(*) FILTER (quality = 0 AND toxic = 1) AS n01, count(*) FILTER (quality = 0 AND toxic = 0) AS n00 FROM documents JOIN labels USING (doc_id) GROUP BY 1), "
    "k AS (SELECT *, unnest(range(greatest(0, n11 + n01 - n01 - n00 ), least(n11 + n10, n11 + n01) + 1)) AS k FROM s), "
    "l AS (SELECT *, lgamma(n11+n10+1.0) - lgamma(k+1.0) - lgamma(n11+n10-k+1.0) + lgamma(n01+n00+1.0) - lgamma(n11+n01-k+1.0) - lgamma(n01+n00-n11-n01+k+1.0) - lgamma(n11+n10+n01+n00+1.0) + lgamma(n11+n01+1.0) + lgamma(n10+n00+1.0) AS lp FROM k WHERE n01 + n00 - n11 - n01 + k >= 0), "
    "o AS (SELECT lang, max(lp) FILTER (k = n11) AS lo FROM l GROUP BY 1) "
    f"SELECT lang, any_value(n11) AS n11, any_value(n10) AS n10, any_value(n01) AS n01, any_value(n00) AS n00, CASE WHEN any_value(n10 * n01) > 0 THEN {R('any_value(CAST(n11 AS DOUBLE) * n00 / (n10 * n01))')} END AS odds, {R('least(sum(CASE WHEN exp(lp) <= exp(lo) * (1 + 1e-7) THEN exp(lp) ELSE 0 END), 1.0)')} AS p FROM l JOIN o USING (lang) GROUP BY 1",
)
def fisher_exact(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return rounded(S.fisher_exact(d.withColumn("q", F.col("quality") == 1).withColumn("t", F.col("toxic") == 1), ["lang"], "q", "t"))


@query(
    "sign_test",
    "H9",
    "WITH g AS (SELECT event_type, count(*) FILTER (value > 25) AS n_pos, count(*) FILTER (value < 25) AS n_neg FROM events GROUP BY 1), "
    "k AS (SELECT *, unnest(range(0, least(n_pos, n_neg) + 1)) AS i FROM g) "
    f"SELECT event_type, n_pos, n_neg, {R('least(1.0, 2 * sum(exp(lgamma(n_pos + n_neg + 1.0) - lgamma(i + 1.0) - lgamma(n_pos + n_neg - i + 1.0) - (n_pos + n_neg) * ln(2.0))))')} AS p FROM k GROUP BY 1, 2, 3",
)
def sign_test(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("value") - 25).alias("d"))
    return rounded(S.sign_test(e, ["event_type"], "d"))


@query(
    "wilcoxon",
    "H10",
    "WITH s AS (SELECT event_type, round(value - 25, 2) AS d FROM events WHERE round(value - 25, 2) <> 0), r AS (SELECT event_type, d, rank() OVER w + (count(*) OVER (PARTITION BY event_type, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY event_type, abs(d)) AS t FROM s WINDOW w AS (PARTITION BY event_type ORDER BY abs(d))), "
    "g AS (SELECT event_type, count(*) AS n, sum(r) FILTER (d > 0) AS w, sum(CAST(t AS DOUBLE) * t - 1) AS ts FROM r GROUP BY 1), "
    "z AS (SELECT *, (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2.0 * n + 1) / 24 - ts / 48) AS z FROM g) "
    f"SELECT event_type, n, {R('w', 1)} AS w_plus, {R('2 * ' + z_tail_sql('z'))} AS p FROM z",
)
def wilcoxon(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.round(F.col("value") - 25, 2).alias("d"))
    return rounded(S.wilcoxon(e, ["event_type"], "d"), 6, w_plus=1)


_BH = (
    "q AS (SELECT *, p * count(*) OVER ({f}) / rank_max AS raw FROM (SELECT *, count(*) OVER ({f} ORDER BY p RANGE UNBOUNDED PRECEDING) AS rank_max FROM pv)), "
    "a AS (SELECT *, least(1.0, min(raw) OVER ({f} ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adj FROM q)"
)


@query("bh_adjust", "H11", f"WITH pv AS (SELECT event_type, event_id, value / 500 AS p FROM events), {_BH.format(f='PARTITION BY event_type')} SELECT event_type, event_id, {R('adj', 9)} AS p_adj FROM a")
def bh_adjust(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", (F.col("value") / 500).alias("p"))
    return rounded(S.bh(e, ["event_type"], "p").select("event_type", "event_id", "p_adj"), 9)


@query("bh_adjust_all", "H11", f"WITH pv AS (SELECT event_id, value / 500 AS p FROM events), {_BH.format(f='PARTITION BY 1')} SELECT event_id, {R('adj', 9)} AS p_adj FROM a")
def bh_adjust_all(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("value") / 500).alias("p"))
    return rounded(S.bh(e, [], "p").select("event_id", "p_adj"), 9)


@query("bonferroni", "H11", f"SELECT event_type, event_id, {R('least(value / 500000 * count(*) OVER (PARTITION BY event_type), 1.0)', 9)} AS p_adj FROM events")
def bonferroni(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", (F.col("value") / 500000).alias("p"))
    return rounded(S.bonferroni(e, ["event_type"], "p").select("event_type", "event_id", "p_adj"), 9)


@query(
    "tail_probabilities",
    "X13",
    "WITH s AS (SELECT p_size, avg(p_retailprice) / 700 AS x, CAST(count(*) AS DOUBLE) AS v FROM part GROUP BY 1) "
    f"SELECT p_size, {R(t_tail_sql('x', 'v'))} AS t, {R(f_tail_sql('x', '3.0', 'v'), 6)} AS f, {R(chi2_tail_sql('(x * 4)', '5.0'))} AS c, {R(z_tail_sql('x'))} AS z FROM s",
)
def tail_probabilities(spark, sf):
    s = table(spark, sf, "part").groupBy("p_size").agg((F.avg("p_retailprice") / 700).alias("x"), F.count("*").cast("double").alias("v"))
    return rounded(
        s.select(
            "p_size", tails.t_tail("x", "v").alias("t"), tails.f_tail("x", F.lit(3.0), "v").alias("f"), tails.chi2_tail(F.col("x") * 4, F.lit(5.0)).alias("c"), tails.z_tail("x").alias("z")
        )
    )


@query(
    "corr_many",
    "D12",
    "WITH u AS (SELECT 'l_discount' AS variable, l_discount AS v, l_quantity AS y FROM lineitem UNION ALL SELECT 'l_tax', l_tax, l_quantity FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber, l_quantity FROM lineitem), "
    f"g AS (SELECT variable, count(*) AS n, corr(v, y) AS r FROM u GROUP BY 1), pv AS (SELECT *, {_r_p()} AS p FROM g), {_BH.format(f='PARTITION BY 1')} SELECT variable, n, {R('r')} AS r, {R('p', 5)} AS p, {R('adj', 5)} AS p_adj FROM a",
)
def corr_many(spark, sf):
    d = lines(spark, sf, F.col("l_quantity").alias("y"), "l_discount", "l_tax", F.col("l_linenumber").cast("double").alias("l_linenumber"))
    long = d.unpivot(["y"], ["l_discount", "l_tax", "l_linenumber"], "variable", "v")
    return rounded(S.bh(S.pearson(long, ["variable"], "v", "y"), [], "p", small_family=True), 6, p=5, p_adj=5)


@query(
    "trend_by_level",
    "D13 H5",
    "WITH lv AS (SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS level, o_orderstatus AS pathway FROM orders), "
    f"c AS (SELECT pathway AS k, level AS x, l_quantity AS y, CAST(count(*) AS DOUBLE) AS c FROM lineitem JOIN lv ON o_orderkey = l_orderkey GROUP BY 1, 2, 3), {_JT} "
    f"SELECT k AS pathway, CAST(n AS BIGINT) AS n, {R('j', 1)} AS j, {R('z', 5)} AS z FROM z",
)
def trend_by_level(spark, sf):
    lv = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), F.col("o_orderstatus").alias("pathway"))
    d = lines(spark, sf, "l_orderkey", F.abs("l_quantity").alias("v")).join(lv, "l_orderkey")
    return rounded(S.jonckheere(d, ["pathway"], "level", "v").select("pathway", "n", "j", "z"), 5, j=1)


@query(
    "map_correlation",
    "D14 A5",
    f"WITH {EMB}, m AS (SELECT parcel, avg(value) FILTER (label < 5) AS a, avg(value) FILTER (label >= 5) AS b FROM emb GROUP BY 1), g AS (SELECT count(*) AS n, corr(a, b) AS r FROM m) SELECT n, {R('r')} AS r, {R(_r_p())} AS p FROM g",
)
def map_correlation(spark, sf):
    e = emb_long(spark, sf)
    m = e.groupBy("parcel").agg(F.avg(F.when(F.col("label") < 5, F.col("value"))).alias("a"), F.avg(F.when(F.col("label") >= 5, F.col("value"))).alias("b"))
    return rounded(S.pearson(m, [], "a", "b"))


@query("masked_map_comparison", "P9 J11", f"WITH {TM}, m AS (SELECT ta.t AS a, tb.t AS b FROM ta JOIN tb USING (parcel) WHERE ta.t <> 0 AND tb.t <> 0), g AS (SELECT count(*) AS n, corr(a, b) AS r FROM m) SELECT n, {R('r')} AS r, {R(_r_p())} AS p FROM g")
def masked_map_comparison(spark, sf):
    a, b = t_maps(spark, sf)
    m = A.pair_maps(a.withColumnRenamed("t", "a"), b.withColumnRenamed("t", "b"), "parcel", "a", "b", drop_zero=True)
    return rounded(S.pearson(m, [], "a", "b"))


@query(
    "gram_narrow",
    "A17",
    "WITH v AS (SELECT l_returnflag, l_linenumber, [1.0::DOUBLE, l_quantity, l_discount, l_tax] AS v FROM lineitem), "
    "ij AS (SELECT i, j FROM range(0, 4) a(i), range(0, 4) b(j) WHERE i <= j) "
    f"SELECT l_returnflag, l_linenumber, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {R('sum(v[i + 1] * v[j + 1])', 4)} AS value FROM v, ij GROUP BY 1, 2, 3, 4",
)
def gram_narrow(spark, sf):
    g = GR.gram_narrow(table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])
    return rounded(GR.cells(g, ["l_returnflag", "l_linenumber"], 3), 4)


@query(
    "gram_wide",
    "A17",
    "WITH v AS (SELECT label, list_prepend(1.0::DOUBLE, embedding::DOUBLE[]) AS v FROM embeddings), ij AS (SELECT i, j FROM range(0, 65) a(i), range(0, 65) b(j) WHERE i <= j) "
    f"SELECT label, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {R('sum(v[i + 1] * v[j + 1])', 5)} AS value FROM v, ij GROUP BY 1, 2, 3",
)
def gram_wide(spark, sf):
    g = GR.gram_wide(table(spark, sf, "embeddings"), ["label"], "embedding", 64)
    return rounded(GR.cells(g, ["label"], 64), 5)


@query(
    "moments_wide",
    "A17",
    "WITH v AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings), ij AS (SELECT i, j FROM range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j) "
    f"SELECT label, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {R('covar_pop(v[i], v[j]) * count(*)', 5)} AS value FROM v, ij GROUP BY 1, 2, 3",
)
def moments_wide(spark, sf):
    """Products around the mean, merged pairwise, of vectors that are moved by a thousand."""
    e = table(spark, sf, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double") + 1000.0).alias("v"))
    return rounded(GR.cells(GR.moments_wide(e, ["label"], "v", 64), ["label"], 64).filter("i > 0"), 5)


@query(
    "moments_narrow",
    "A17",
    "WITH v AS (SELECT l_returnflag, l_linenumber, [l_quantity, l_discount, l_tax]::DOUBLE[] AS v FROM lineitem), ij AS (SELECT i, j FROM range(1, 4) a(i), range(1, 4) b(j) WHERE i <= j) "
    f"SELECT l_returnflag, l_linenumber, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {R('covar_pop(v[i], v[j]) * count(*)', 4)} AS value FROM v, ij GROUP BY 1, 2, 3, 4",
)
def moments_narrow(spark, sf):
    """Products around the mean of a few columns that are moved by ten thousand."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", *[(F.col(c) + 1e4).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    g = GR.moments(li, ["l_returnflag", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])
    return rounded(GR.cells(g, ["l_returnflag", "l_linenumber"], 3).filter("i > 0"), 4)


@query(
    "train_complement",
    "U4 A17",
    "WITH v AS (SELECT l_returnflag, l_linenumber AS fold, [1.0::DOUBLE, l_quantity, l_discount] AS v FROM lineitem), f AS (SELECT DISTINCT l_linenumber AS fold FROM lineitem), ij AS (SELECT i, j FROM range(0, 3) a(i), range(0, 3) b(j) WHERE i <= j) "
    f"SELECT l_returnflag, f.fold, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {R('sum(v[i + 1] * v[j + 1])', 4)} AS value FROM v JOIN f ON v.fold <> f.fold, ij GROUP BY 1, 2, 3, 4",
)
def train_complement(spark, sf):
    li = lines(spark, sf, "l_returnflag", F.col("l_linenumber").alias("fold"), "l_quantity", "l_discount")
    g = GR.complement(GR.gram_narrow(li, ["l_returnflag", "fold"], ["l_quantity", "l_discount"]), ["l_returnflag"], "fold")
    return rounded(GR.cells(g, ["l_returnflag", "fold"], 2), 4)
