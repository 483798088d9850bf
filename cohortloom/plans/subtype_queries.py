"""Normative deviation, path models and subtypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.scalar import dummy
from cohortloom.operators import normative as V
from cohortloom.operators import paths as PA
from cohortloom.operators import stats as S
from cohortloom.operators import subtype as B
from cohortloom.operators.cohort import any_of, shared_control_union
from cohortloom.operators.temporal import join_stats
from cohortloom.plans.catalog import R, chi2_tail_sql, f_tail_sql, query, rounded, t_tail_sql, table
from cohortloom.plans.model_queries import PROF, PROFILE, profiles
from cohortloom.plans.stats_queries import _BH, ANOVA


def ages(spark, sf):
    """Profiles with an age, a sex and a group (label below 5 are controls)."""
    p = profiles(spark, sf)
    return p.withColumns(
        {"age": (F.col("vec_id") % 90) / 6 + 5, "sex": (F.col("vec_id") % 2).cast("int"), "grp": F.when(F.col("label") < 5, "TD").otherwise("ASD"), "cluster": (F.col("label") % 3).cast("int")}
    )


AG = f"{PROF}, ag AS (SELECT *, (vec_id % 90) / 6.0::DOUBLE + 5 AS age, CAST(vec_id % 2 AS INTEGER) AS sex, CASE WHEN label < 5 THEN 'TD' ELSE 'ASD' END AS grp, CAST(label % 3 AS INTEGER) AS cluster FROM pf)"


@query("normative_fit", "V1")
def normative_fit(spark, sf):
    m = V.normative_fit(ages(spark, sf).filter("grp = 'TD'"), PROFILE, "age", "sex")
    return rounded(m.select("variable", "n", "model", "aic_linear", "aic_smooth", "sigma", "r2"), 4)


@query("deviation", "V1 V2")
def deviation(spark, sf):
    a = ages(spark, sf)
    m = V.normative_fit(a.filter("grp = 'TD'"), PROFILE, "age", "sex")
    return rounded(V.deviation(a, m, ["vec_id", "grp"], PROFILE, "age", "sex"), 4)


_LONG = "lg AS (UNPIVOT (SELECT vec_id, age, sex, grp, cluster, v0, v1, v2, v3, v4, v5 FROM ag) ON v0, v1, v2, v3, v4, v5 INTO NAME variable VALUE y)"


@query(
    "deviation_linear",
    "V2",
    f"WITH {AG}, {_LONG}, c AS (SELECT * FROM lg WHERE grp = 'TD'), m AS (SELECT variable, count(*) AS n, avg(y) AS my, avg(age) AS ma, avg(sex) AS ms, regr_slope(y, sex) AS ys, regr_slope(age, sex) AS gs FROM c GROUP BY 1), "
    "r AS (SELECT variable, n, y - my - ys * (sex - ms) AS ry, age - ma - gs * (sex - ms) AS ra FROM c JOIN m USING (variable)), "
    "f AS (SELECT variable, sum(ra * ry) / sum(ra * ra) AS b, sqrt((sum(ry * ry) - pow(sum(ra * ry), 2) / sum(ra * ra)) / (any_value(n) - 3)) AS sigma FROM r GROUP BY 1) "
    f"SELECT vec_id, variable, {R('(y - my - ys * (sex - ms) - b * (age - ma - gs * (sex - ms))) / sigma', 5)} AS z FROM lg JOIN m USING (variable) JOIN f USING (variable)",
)
def deviation_linear(spark, sf):
    """Deviation under the linear model: the smooth is ruled out by an unreachable gain."""
    a = ages(spark, sf)
    m = V.normative_fit(a.filter("grp = 'TD'"), PROFILE, "age", "sex", delta=float("inf"))
    return rounded(V.deviation(a, m, ["vec_id"], PROFILE, "age", "sex").select("vec_id", "variable", "z"), 5)


@query("trajectory", "V3")
def trajectory(spark, sf):
    m = V.normative_fit(ages(spark, sf).filter("grp = 'TD'"), PROFILE, "age", "sex")
    return rounded(V.trajectory(m), 4)


_CURVE = "cv AS (SELECT CAST(floor((age - 5) * 2) AS INTEGER) AS b, avg(age) AS gx, avg(v0) AS gy FROM ag WHERE grp = 'TD' AND age > 6 AND age < 19 GROUP BY 1)"


def curve(spark, sf):
    """Control trajectory on a short grid: mean profile per half-year bin."""
    a = ages(spark, sf).filter("grp = 'TD' AND age > 6 AND age < 19")
    return a.groupBy(F.floor((F.col("age") - 5) * 2).alias("b")).agg(F.avg("age").alias("gx"), F.avg("v0").alias("gy")).select("gx", "gy")


_INTERP = (
    "sg AS (SELECT gx AS x0, gy AS y0, lead(gx) OVER (ORDER BY gx) AS x1, lead(gy) OVER (ORDER BY gx) AS y1 FROM cv), e AS (SELECT min(gx) AS lo, max(gx) AS hi, arg_min(gy, gx) AS ylo, arg_max(gy, gx) AS yhi FROM cv), "
    "ip AS (SELECT ag.*, CASE WHEN age <= lo THEN ylo WHEN age >= hi THEN yhi ELSE y0 + (y1 - y0) * (age - x0) / (x1 - x0) END AS mu FROM ag CROSS JOIN e LEFT JOIN sg ON age >= x0 AND age < x1 WHERE age >= lo - 0.5 AND age <= hi + 0.5)"
)


@query("interp_lookup", "J7", f"WITH {AG}, {_CURVE}, {_INTERP} SELECT vec_id, {R('mu')} AS mu FROM ip")
def interp_lookup(spark, sf):
    return rounded(V.interp_join(ages(spark, sf), curve(spark, sf), [], "age", "gx", "gy", 0.5, "mu").select("vec_id", "mu"))


@query(
    "adherence",
    "B11 J7 H9",
    f"WITH {AG}, {_CURVE}, {_INTERP}, g AS (SELECT count(*) AS n_total, count(*) FILTER (v0 < mu) AS n_following FROM ip WHERE grp = 'ASD' AND sex = 0), k AS (SELECT *, unnest(range(0, least(n_following, n_total - n_following) + 1)) AS i FROM g) "
    f"SELECT 'v0' AS variable, 'below' AS direction, n_total, n_following, {R('100.0 * n_following / n_total')} AS pct_adherence, {R('least(1.0, 2 * sum(exp(lgamma(n_total + 1.0) - lgamma(i + 1.0) - lgamma(n_total - i + 1.0) - n_total * ln(2.0))))')} AS p FROM k GROUP BY n_total, n_following",
)
def adherence(spark, sf):
    cases = ages(spark, sf).filter("grp = 'ASD' AND sex = 0").withColumn("variable", F.lit("v0"))
    traj = curve(spark, sf).select(F.lit("v0").alias("variable"), F.col("gx").alias("age"), F.col("gy").alias("mu"))
    way = cases.groupBy("variable").agg(F.lit("below").alias("direction"))
    return rounded(B.adherence(cases.select("variable", "age", "v0"), traj, way, "variable", "age", "v0"))


@query(
    "trend_direction",
    "B10 H6",
    f"WITH {AG}, {_LONG}, g AS (SELECT variable, count(*) FILTER (grp = 'ASD') AS n1, count(*) FILTER (grp = 'TD') AS n2, avg(y) FILTER (grp = 'ASD') AS m1, avg(y) FILTER (grp = 'TD') AS m2, var_samp(y) FILTER (grp = 'ASD') AS v1, var_samp(y) FILTER (grp = 'TD') AS v2 FROM lg GROUP BY 1), "
    "t AS (SELECT *, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t FROM g), "
    f"p AS (SELECT *, 2 * {t_tail_sql('t', 'df')} AS p FROM t) SELECT variable, {R('t', 5)} AS t, {R('p', 5)} AS p, CASE WHEN p < 0.3 AND t < 0 THEN 'below' WHEN p < 0.3 THEN 'above' ELSE 'no_difference' END AS direction FROM p",
)
def trend_direction(spark, sf):
    long = ages(spark, sf).unpivot(["vec_id", "grp"], PROFILE, "variable", "z")
    return rounded(B.trend_direction(long, ["variable"], "grp", "ASD", "TD", "z", alpha=0.3).select("variable", "t", "p", "direction"), 5)


@query(
    "analysis_table",
    "V4 X10 F4",
    "WITH s AS (SELECT doc_id AS vec_id, quality, toxic FROM labels), r AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS sem, CAST(embedding[2] AS DOUBLE) AS dim, quality, toxic FROM embeddings JOIN s USING (vec_id)) "
    f"SELECT vec_id, label, {R('sem')} AS sem, {R('dim')} AS dim, {R('(-sem + dim) / 2')} AS avg_dmn, {R('(quality - avg(quality) OVER ()) / stddev_samp(quality) OVER ()')} AS quality, {R('(toxic - avg(toxic) OVER ()) / stddev_samp(toxic) OVER ()')} AS toxic FROM r",
)
def analysis_table(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("sem"), F.col("embedding")[1].cast("double").alias("dim"))
    j = e.join(table(spark, sf, "labels").withColumnRenamed("doc_id", "vec_id"), "vec_id", "left")
    return rounded(V.build_analysis_table(j, "vec_id", {"avg_dmn": ("sem", "dim")}, ["quality", "toxic"], "label"))


PATHV = list(PA.VARIABLES)


def path_rows(spark, sf):
    """Five observed variables per order line for the path models."""
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_returnflag", "l_linestatus",
        (F.col("l_quantity") / 10).alias("sal"),
        (F.col("l_extendedprice") / 10000).alias("cen"),
        (F.col("l_extendedprice") / 20000 + F.col("l_quantity") / 20 + F.col("l_discount") * 10).alias("dmn"),
        (F.col("l_discount") * 20 + F.col("l_linenumber") / 4).alias("cog"),
        (F.col("l_tax") * 20 + F.col("l_extendedprice") / 30000).alias("srs"),
    )


_PV = (
    "pv0 AS (SELECT l_returnflag, l_quantity / 10 AS sal, l_extendedprice / 10000 AS cen, l_extendedprice / 20000 + l_quantity / 20 + l_discount * 10 AS dmn, l_discount * 20 + l_linenumber / 4.0 AS cog, l_tax * 20 + l_extendedprice / 30000 AS srs FROM lineitem)"
)


@query("path_fit", "V5")
def path_fit(spark, sf):
    cov = PA.covariance(path_rows(spark, sf), ["l_returnflag"], PATHV)
    return rounded(PA.path_fit(cov, ["l_returnflag"], PATHV), 4)


@query("path_best_model", "V5 O5")
def path_best_model(spark, sf):
    from cohortloom.operators.ordering import best_model

    cov = PA.covariance(path_rows(spark, sf), [], PATHV)
    fit = PA.path_fit(cov, [], PATHV)
    return rounded(best_model(fit, "model", ["aic", "bic", "chi2", "rmsea", "srmr"], ["cfi", "tli"]), 3)


_COEF = (
    "c AS (SELECT l_returnflag, count(*) AS n, covar_pop(cen, sal) AS sc, var_pop(sal) AS ss, var_pop(cen) AS cc, var_pop(dmn) AS dd, covar_pop(dmn, sal) AS ds, covar_pop(dmn, cen) AS dc, covar_pop(srs, dmn) AS rd, covar_pop(cog, dmn) AS gd, var_pop(srs) AS rr, var_pop(cog) AS gg FROM pv0 GROUP BY 1), "
    "e AS (SELECT *, sc / ss AS a, (dc * ss - ds * sc) / (cc * ss - sc * sc) AS b, (ds * cc - dc * sc) / (cc * ss - sc * sc) AS cp, rd / dd AS d, gd / dd AS e FROM c), "
    "v AS (SELECT *, (cc - a * sc) / ss / n AS va, (dd - b * dc - cp * ds) * ss / (cc * ss - sc * sc) / n AS vb, (dd - b * dc - cp * ds) * cc / (cc * ss - sc * sc) / n AS vc, (rr - d * rd) / dd / n AS vd, (gg - e * gd) / dd / n AS ve FROM e)"
)


@query(
    "indirect_effects",
    "V6",
    f"WITH {_PV}, {_COEF}, r AS (SELECT l_returnflag, 'ind_sal_dmn' AS effect, a * b AS est, sqrt(b*b*va + a*a*vb) AS se FROM v UNION ALL "
    "SELECT l_returnflag, 'total_sal_dmn', cp + a * b, sqrt(vc + b*b*va - a*a*vb) FROM v UNION ALL "
    "SELECT l_returnflag, 'cascade_sal_srs', a * b * d, sqrt(d*d*(b*b*va + a*a*vb) + a*a*b*b*vd) FROM v UNION ALL SELECT l_returnflag, 'cascade_sal_cog', a * b * e, sqrt(e*e*(b*b*va + a*a*vb) + a*a*b*b*ve) FROM v) "
    f"SELECT l_returnflag, effect, {R('est')} AS est, {R('se', 7)} AS se, {R('est / se', 3)} AS z FROM r",
)
def indirect_effects(spark, sf):
    cov = PA.covariance(path_rows(spark, sf), ["l_returnflag"], PATHV)
    return rounded(PA.indirect_effects(PA.path_coefficients(cov, ["l_returnflag"], PATHV), ["l_returnflag"]), 6, se=7, z=3)


@query(
    "path_table",
    "V7",
    f"WITH {_PV}, {_COEF} SELECT l_returnflag, n, {R('a')} AS sal_to_cen_beta, {R('a * sqrt(ss / cc)')} AS sal_to_cen_std, {R('b')} AS cen_to_dmn_beta, {R('cp')} AS sal_to_dmn_beta, {R('d')} AS dmn_to_srs_beta, {R('e')} AS dmn_to_cog_beta, {R('e * sqrt(dd / gg)')} AS dmn_to_cog_std FROM v",
)
def path_table(spark, sf):
    k = ["l_returnflag"]
    cov = PA.covariance(path_rows(spark, sf), k, PATHV)
    t = PA.path_table(PA.path_fit(cov, k, PATHV), PA.path_coefficients(cov, k, PATHV), k)
    return rounded(t.select("l_returnflag", "n", "sal_to_cen_beta", "sal_to_cen_std", "cen_to_dmn_beta", "sal_to_dmn_beta", "dmn_to_srs_beta", "dmn_to_cog_beta", "dmn_to_cog_std"))


@query("deviation_composite", "V9 V8 H1 H2", f"WITH {AG}, d AS (SELECT v0, (v1 + v2 + v3) / 3 AS c FROM ag), r AS (SELECT rank() OVER (ORDER BY v0) AS a, rank() OVER (ORDER BY c) AS b FROM d) SELECT (SELECT count(*) FROM d) AS n, {R('(SELECT corr(v0, c) FROM d)')} AS pearson, {R('(SELECT corr(a, b) FROM r)')} AS spearman")
def deviation_composite(spark, sf):
    from cohortloom.functions.scalar import row_mean

    d = ages(spark, sf).select("v0", row_mean(["v1", "v2", "v3"]).alias("c"))
    a = S.pearson(d, [], "v0", "c").select("n", F.col("r").alias("pearson"))
    return rounded(join_stats(a, S.spearman(d, [], "v0", "c").select(F.col("r").alias("spearman")), []))


@query("path_fit_subsets", "V10 U1 V5")
def path_fit_subsets(spark, sf):
    """Every subset shares the controls (flag N); the model is refitted per subset."""
    u = shared_control_union(path_rows(spark, sf), "l_returnflag", F.col("l_returnflag") == "N", ["A", "R"])
    fit = PA.path_fit(PA.covariance(u, ["subset_id"], PATHV), ["subset_id"], PATHV, PA.STRUCTURES[:1])
    return rounded(fit, 4)


@query("group_invariance", "V11")
def group_invariance(spark, sf):
    cov = PA.covariance(path_rows(spark, sf), ["l_linestatus", "l_returnflag"], PATHV)
    return rounded(PA.group_invariance(cov, "l_returnflag", PATHV, PA.STRUCTURES[0], ["l_linestatus"]), 4)


@query(
    "characterise",
    "B5",
    f"WITH {AG} SELECT cluster, count(*) AS n, {R('avg(age)')} AS mean_age, {R('stddev_pop(age)')} AS sd_age, {R('avg(CASE WHEN sex = 0 THEN 1.0 ELSE 0.0 END)')} AS male_ratio FROM ag GROUP BY 1",
)
def characterise(spark, sf):
    return rounded(B.characterise(ages(spark, sf).withColumn("male", dummy("sex", 0)), "cluster", "age", "male"))


@query(
    "demographic_tests",
    "B5 H7 H8",
    f"WITH {AG}, one AS (SELECT 1 AS one, * FROM ag), {ANOVA.format(key='one', g='cluster', v='age', t='one')}, "
    "o AS (SELECT cluster AS a, sex AS b, count(*) AS o FROM ag GROUP BY 1, 2), e AS (SELECT o, CAST(sum(o) OVER (PARTITION BY a) AS DOUBLE) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM o), c AS (SELECT sum(pow(o - e, 2) / e) AS x FROM e) "
    f"SELECT 'age' AS test, {R('f', 5)} AS stat, {R(f_tail_sql('f', 'CAST(k - 1 AS DOUBLE)', 'CAST(n_total - k AS DOUBLE)'), 5)} AS p FROM f UNION ALL SELECT 'sex', {R('x', 5)}, {R(chi2_tail_sql('x', '2.0'), 5)} FROM c",
)
def demographic_tests(spark, sf):
    return rounded(B.demographic_tests(ages(spark, sf).withColumn("male", dummy("sex", 0)), "cluster", "age", "male"), 5)


_FISHER = (
    "fk AS (SELECT *, n11 + n10 AS r1, n01 + n00 AS r2, n11 + n01 AS c1, unnest(range(greatest(0, n11 - n00), least(n11 + n10, n11 + n01) + 1)) AS k FROM ft), "
    "fl AS (SELECT *, lgamma(r1+1.0) - lgamma(k+1.0) - lgamma(r1-k+1.0) + lgamma(r2+1.0) - lgamma(c1-k+1.0) - lgamma(r2-c1+k+1.0) - lgamma(r1+r2+1.0) + lgamma(c1+1.0) + lgamma(r1+r2-c1+1.0) AS lp FROM fk), "
    "fo AS (SELECT category, max(lp) FILTER (k = n11) AS seen FROM fl GROUP BY 1), "
    "pv AS (SELECT category, CASE WHEN any_value(n10 * n01) > 0 THEN any_value(CAST(n11 AS DOUBLE) * n00 / (n10 * n01)) END AS odds, least(1.0, sum(exp(lp)) FILTER (lp <= seen + 1e-7)) AS p FROM fl JOIN fo USING (category) GROUP BY 1)"
)


@query(
    "demographic_tests_two",
    "B5 H6 H8",
    f"WITH {AG}, g AS (SELECT count(*) FILTER (label % 2 = 0) AS n1, count(*) FILTER (label % 2 = 1) AS n2, avg(age) FILTER (label % 2 = 0) AS m1, avg(age) FILTER (label % 2 = 1) AS m2, var_samp(age) FILTER (label % 2 = 0) AS v1, var_samp(age) FILTER (label % 2 = 1) AS v2 FROM ag), "
    "t AS (SELECT CAST(n1 + n2 - 2 AS DOUBLE) AS df, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t FROM g), "
    "ft AS (SELECT 'sex' AS category, count(*) FILTER (label % 2 = 0 AND sex = 0) AS n11, count(*) FILTER (label % 2 = 0 AND sex = 1) AS n10, count(*) FILTER (label % 2 = 1 AND sex = 0) AS n01, count(*) FILTER (label % 2 = 1 AND sex = 1) AS n00 FROM ag), "
    f"{_FISHER} SELECT 'age' AS test, {R('t', 5)} AS stat, {R('2 * ' + t_tail_sql('t', 'df'), 5)} AS p FROM t UNION ALL SELECT category, {R('odds', 5)}, {R('p', 5)} FROM pv",
)
def demographic_tests_two(spark, sf):
    """Two clusters: pooled t of age and the exact test of sex."""
    a = ages(spark, sf).withColumn("male", dummy("sex", 0)).withColumn("two", (F.col("label") % 2).cast("int"))
    return rounded(B.demographic_tests(a, "two", "age", "male"), 5)


@query("cluster_features", "B6 B2", f"WITH {AG} SELECT cluster, " + ", ".join(f"{R(f'avg(CASE WHEN abs(v{i}) > 1 THEN 1.0 ELSE 0.0 END)')} AS v{i}" for i in range(6)) + " FROM ag GROUP BY 1")
def cluster_features(spark, sf):
    from cohortloom.operators.cluster import outlier_flags

    return rounded(B.cluster_features(outlier_flags(ages(spark, sf), PROFILE, 1.0), "cluster", PROFILE))


@query("cluster_profile", "B14", f"WITH {AG}, {_LONG} SELECT cluster, variable, count(*) AS n, {R('avg(y)')} AS mean, {R('stddev_samp(y)')} AS sd FROM lg GROUP BY 1, 2")
def cluster_profile(spark, sf):
    return rounded(B.cluster_profile(ages(spark, sf), "cluster", PROFILE))


_DOM = "CASE WHEN variable IN ('v0', 'v1', 'v2') THEN 'social' ELSE 'cognition' END"
_ITEMS = f"{AG}, {_LONG}, {ANOVA.format(key='variable', g='cluster', v='y', t='lg')}, pv AS (SELECT *, {_DOM} AS domain, {f_tail_sql('f', 'CAST(k - 1 AS DOUBLE)', 'CAST(n_total - k AS DOUBLE)')} AS p FROM f)"


@query("item_tests", "B7 H7 H11", f"WITH {_ITEMS}, {_BH.format(f='PARTITION BY domain')} SELECT variable AS item, domain, {R('f', 5)} AS f, {R('p', 5)} AS p, {R('adj', 5)} AS p_adj FROM a")
def item_tests(spark, sf):
    t = B.item_tests(ages(spark, sf), "cluster", {"social": ["v0", "v1", "v2"], "cognition": ["v3", "v4", "v5"]}, small_family=True)
    return rounded(t.select("item", "domain", "f", "p", "p_adj"), 5)


@query("manova", "B8")
def manova(spark, sf):
    return rounded(B.manova(ages(spark, sf), [], "cluster", PROFILE), 5)


@query(
    "manova_two",
    "B8",
    f"WITH {AG}, w AS (SELECT sum(n * a) AS w00, sum(n * b) AS w11, sum(n * c) AS w01 FROM (SELECT cluster, count(*) AS n, var_pop(v0) AS a, var_pop(v1) AS b, covar_pop(v0, v1) AS c FROM ag GROUP BY 1)), "
    f"t AS (SELECT count(*) * var_pop(v0) AS t00, count(*) * var_pop(v1) AS t11, count(*) * covar_pop(v0, v1) AS t01, count(*) AS n FROM ag) SELECT n, {R('(w00 * w11 - w01 * w01) / (t00 * t11 - t01 * t01)')} AS wilks FROM w, t",
)
def manova_two(spark, sf):
    return rounded(B.manova(ages(spark, sf), [], "cluster", ["v0", "v1"]).select("n", "wilks"))


@query(
    "category_tests",
    "B9 A10 H8",
    "WITH d AS (SELECT lang, CASE WHEN quality = 1 OR toxic = 1 THEN 1 ELSE 0 END AS any_flag, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS toxic_flag FROM documents LEFT JOIN labels USING (doc_id)), "
    "u AS (SELECT lang, 'any_flag' AS category, any_flag AS flag FROM d UNION ALL SELECT lang, 'toxic_flag', toxic_flag FROM d), o AS (SELECT category, lang, flag, count(*) AS o FROM u GROUP BY 1, 2, 3), "
    "e AS (SELECT category, o, CAST(sum(o) OVER (PARTITION BY category, lang) AS DOUBLE) * sum(o) OVER (PARTITION BY category, flag) / sum(o) OVER (PARTITION BY category) AS e FROM o), k AS (SELECT count(DISTINCT lang) AS k FROM d), "
    f"pv AS (SELECT category, any_value(k) AS k, sum(pow(o - e, 2) / e) + sum(o) - sum(e) AS x FROM e, k GROUP BY 1), pp AS (SELECT category, x, {chi2_tail_sql('x', 'CAST(k - 1 AS DOUBLE)')} AS p FROM pv) SELECT category, {R('x', 5)} AS stat, {R('p', 5)} AS p FROM pp",
)
def category_tests(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    t = B.category_tests(d, "lang", {"any_flag": any_of(["quality", "toxic"]), "toxic_flag": any_of(["toxic"])}, small_family=True)
    return rounded(t.select("category", "stat", "p"), 5)


@query(
    "category_tests_two",
    "B9 A10 H8 H11",
    "WITH d AS (SELECT quality, toxic = 1 AS toxic_flag, n_chars > 500 AS long_text FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), "
    "u AS (SELECT quality, 'toxic_flag' AS category, toxic_flag AS flag FROM d UNION ALL SELECT quality, 'long_text', long_text FROM d), "
    "ft AS (SELECT category, count(*) FILTER (quality = 1 AND flag) AS n11, count(*) FILTER (quality = 1 AND NOT flag) AS n10, count(*) FILTER (quality = 0 AND flag) AS n01, count(*) FILTER (quality = 0 AND NOT flag) AS n00 FROM u GROUP BY 1), "
    f"{_FISHER}, {_BH.format(f='PARTITION BY 1')} SELECT category, {R('odds', 5)} AS stat, {R('p', 5)} AS p, {R('adj', 5)} AS p_adj FROM a",
)
def category_tests_two(spark, sf):
    """Two clusters (quality 1 and 0) against each category: exact tests, adjusted over categories."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id").filter("quality is not null")
    t = B.category_tests(d, "quality", {"toxic_flag": F.col("toxic") == 1, "long_text": F.col("n_chars") > 500}, first=1, small_family=True)
    return rounded(t.select("category", "stat", "p", "p_adj"), 5)


@query(
    "interaction_anova",
    "B12",
    f"WITH {AG}, {_LONG}, c AS (SELECT variable, cluster, count(*) AS n, avg(age) AS mx, avg(y) AS my, var_pop(age) * count(*) AS sxx, var_pop(y) * count(*) AS syy, covar_pop(age, y) * count(*) AS sxy FROM lg GROUP BY 1, 2), "
    "w AS (SELECT variable, sum(n) AS n, count(*) AS k, sum(sxx) AS wxx, sum(syy) AS wyy, sum(sxy) AS wxy, sum(sxy * sxy / sxx) AS own FROM c GROUP BY 1), t AS (SELECT variable, var_pop(age) * count(*) AS txx, var_pop(y) * count(*) AS tyy, covar_pop(age, y) * count(*) AS txy FROM lg GROUP BY 1), "
    "f AS (SELECT variable, CAST(n AS BIGINT) AS n_total, k, (wxy * wxy / wxx) / ((wyy - own) / (n - 2 * k)) AS age_f, ((tyy - txy * txy / txx) - (wyy - wxy * wxy / wxx)) / (k - 1) / ((wyy - own) / (n - 2 * k)) AS cluster_f, (own - wxy * wxy / wxx) / (k - 1) / ((wyy - own) / (n - 2 * k)) AS interaction_f FROM w JOIN t USING (variable)) "
    f"SELECT variable, n_total, k, {R('age_f', 5)} AS age_f, {R('cluster_f', 5)} AS cluster_f, {R('interaction_f', 5)} AS interaction_f, {R(f_tail_sql('interaction_f', 'CAST(k - 1 AS DOUBLE)', 'CAST(n_total - 2 * k AS DOUBLE)'), 5)} AS interaction_p FROM f",
)
def interaction_anova(spark, sf):
    long = ages(spark, sf).unpivot(["vec_id", "age", "cluster"], PROFILE, "variable", "y")
    t = B.interaction_anova(long, ["variable"], "cluster", "age", "y", small_family=True)
    return rounded(t.select("variable", "n_total", "k", "age_f", "cluster_f", "interaction_f", "interaction_p"), 5)


@query("interaction_slopes", "B12 H4", f"WITH {AG}, {_LONG} SELECT variable, cluster, count(*) AS n, {R('regr_slope(y, age)')} AS slope, {R('regr_intercept(y, age)')} AS intercept FROM lg GROUP BY 1, 2")
def interaction_slopes(spark, sf):
    long = ages(spark, sf).unpivot(["vec_id", "age", "cluster"], PROFILE, "variable", "y")
    return rounded(B.cluster_slopes(long, ["variable"], "cluster", "age", "y"))


_WITH_C = f"{AG}, {_LONG}, lc AS (SELECT variable, y, CASE WHEN grp = 'TD' THEN 'control' ELSE 'c' || cluster END AS g FROM lg), {ANOVA.format(key='variable', g='g', v='y', t='lc')}"


def with_controls(spark, sf):
    a = ages(spark, sf)
    return a.withColumn("g", F.when(F.col("grp") == "TD", "control").otherwise(F.concat(F.lit("c"), F.col("cluster"))))


@query("anova_with_controls", "B13 U1 H7", f"WITH {_WITH_C} SELECT variable AS item, n_total, k, {R('f', 5)} AS f, {R(f_tail_sql('f', 'CAST(k - 1 AS DOUBLE)', 'CAST(n_total - k AS DOUBLE)'), 5)} AS p FROM f")
def anova_with_controls(spark, sf):
    t, _ = B.item_tests_with_controls(with_controls(spark, sf), "g", PROFILE)
    return rounded(t.select("item", "n_total", "k", "f", "p"), 5)


@query("tukey_pairs", "B13")
def tukey_pairs(spark, sf):
    _, pairs = B.item_tests_with_controls(with_controls(spark, sf), "g", PROFILE, alpha=1.1)
    return rounded(pairs, 4)


