"""Linear models, harmonisation, axes, similarity and clustering on the embedding cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import atlas as A
from cohortloom.operators import axis as AX
from cohortloom.operators import cluster as CL
from cohortloom.operators import dimension as D
from cohortloom.operators import glm as G
from cohortloom.operators import stats as S
from cohortloom.operators.cohort import group_mean
from cohortloom.operators.harmonize import combat
from cohortloom.operators.ordering import argmax_by
from cohortloom.operators.temporal import join_stats, zscore
from cohortloom.plans.atlas_queries import _NET, networks, sections
from cohortloom.plans.catalog import EMB, R, WIDTH, emb_long, query, rounded, t_tail_sql, table
from cohortloom.plans.stats_queries import _BH
from cohortloom.session import cut


def design(spark, sf):
    """Long cells with the group (label below 5) and one covariate."""
    e = emb_long(spark, sf)
    return e.withColumn("grp", (F.col("label") < 5).cast("int")).withColumn("cov", (F.col("vec_id") % 7).cast("double"))


# Group effect with one covariate, by regressing both sides on the covariate first.
_FW = (
    "d AS (SELECT parcel, CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE 0.0 END AS g, CAST(vec_id % 7 AS DOUBLE) AS c, {y} AS y FROM {src}), "
    "m AS (SELECT parcel, count(*) AS n, avg(g) AS mg, avg(c) AS mc, avg(y) AS my, regr_slope(g, c) AS gc, regr_slope(y, c) AS yc FROM d GROUP BY 1), "
    "r AS (SELECT parcel, n, g - mg - gc * (c - mc) AS rg, y - my - yc * (c - mc) AS ry FROM d JOIN m USING (parcel)), "
    "f AS (SELECT parcel, any_value(n) AS n, sum(rg * ry) / sum(rg * rg) AS beta, sum(ry * ry) - pow(sum(rg * ry), 2) / sum(rg * rg) AS sse, sum(rg * rg) AS sgg FROM r GROUP BY 1), "
    "t AS (SELECT parcel, n, beta, sqrt(sse / (n - 3) / sgg) AS se, beta / sqrt(sse / (n - 3) / sgg) AS t, CAST(n - 3 AS DOUBLE) AS df FROM f)"
)
_GLM = f"{EMB}, {_FW.format(y='value', src='emb')}"


@query(
    "group_glm",
    "D9 D10",
    f"WITH {_GLM} SELECT parcel, n, {R('beta', 7)} AS beta, {R('se', 7)} AS se, {R('t', 4)} AS t, df, {R('2 * ' + t_tail_sql('t', 'df'), 5)} AS p, TRUE AS tested FROM t",
)
def group_glm(spark, sf):
    return rounded(G.glm(design(spark, sf), ["parcel"], "value", ["grp", "cov"], "two"), 7, t=4, p=5)


@query(
    "group_glm_offset",
    "D9 D10 A17",
    f"WITH {_GLM} SELECT parcel, n, {R('t', 3)} AS t, df, {R('2 * ' + t_tail_sql('t', 'df'), 4)} AS p, TRUE AS tested FROM t",
)
def group_glm_offset(spark, sf):
    """The models of ``group_glm`` with every value moved by a million: t and p stay what they are."""
    far = design(spark, sf).withColumn("value", F.col("value") + 1e6)
    return rounded(G.glm(far, ["parcel"], "value", ["grp", "cov"], "two").select("parcel", "n", "t", "df", "p", "tested"), 3, p=4)


@query(
    "group_glm_fdr",
    "D9 D10 D11 H11",
    f"WITH {_GLM}, pv AS (SELECT *, {t_tail_sql('t', 'df')} AS p FROM t), {_BH.format(f='PARTITION BY 1')} SELECT parcel, {R('t', 4)} AS t, {R('p', 5)} AS p, {R('adj', 5)} AS p_adj, CAST(CASE WHEN adj < 0.025 THEN sign(t) ELSE 0 END AS INTEGER) AS sig FROM a",
)
def group_glm_fdr(spark, sf):
    g = G.glm_fdr(design(spark, sf), "parcel", "value", ["grp", "cov"], "one", 0.025, small_family=True)  # one row per cell of the vector
    return rounded(g.select("parcel", "t", "p", "p_adj", "sig"), 5, t=4)


@query(
    "group_axis",
    "F1 S2 W5 D9 D11 H11 A1 A3c",
    f"WITH {EMB}, kept AS (SELECT * FROM emb WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 0)), z AS (SELECT vec_id, label, parcel, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM kept WINDOW w AS (PARTITION BY vec_id)), "
    f"{_FW.format(y='z', src='z')}, pv AS (SELECT *, {t_tail_sql('t', 'df')} AS p FROM t), {_BH.format(f='PARTITION BY 1')}, {_NET}, "
    "s AS (SELECT parcel, t, CASE WHEN adj < 0.025 THEN sign(t) ELSE 0 END AS sig FROM a) "
    f"SELECT network, CAST(sum(greatest(sig, 0)) AS BIGINT) AS n_positive, CAST(sum(least(sig, 0)) AS BIGINT) AS n_negative, count(*) AS n, {R('avg(t)', 4)} AS mean_t FROM net JOIN s USING (parcel) GROUP BY 1",
)
def group_axis(spark, sf):
    """Flagship: quality control, z-score per subject, model per parcel, FDR, network roll-up."""
    bad = table(spark, sf, "labels").filter("toxic = 1 AND quality = 0").select(F.col("doc_id").alias("vec_id"))
    e = design(spark, sf).join(bad, "vec_id", "left_anti")
    z = zscore(e, ["vec_id"], "value")
    g = G.glm_fdr(z, "parcel", "z", ["grp", "cov"], "one", 0.025, small_family=True)  # one row per cell of the vector
    nets = networks(spark, sf)
    signs = A.signed_rollup(g, nets, "parcel", "network", "sig")
    means = nets.join(g, "parcel").groupBy("network").agg(F.count("*").alias("n"), F.avg("t").alias("mean_t"))
    return rounded(signs.join(means, "network"), 4)


@query("combat", "D1")
def combat_query(spark, sf):
    """Cells harmonised over the covariate's seven sites: per feature (quarter of the vector) and
    parcel, keeping the group effect."""
    e = design(spark, sf).withColumn("feature", F.floor(F.col("parcel") / 16).cast("int"))
    h = combat(e, "feature", "parcel", "cov", "value", ["grp"])
    return rounded(h.select("vec_id", "parcel", "value", "harmonised"))


def vectors(spark, sf, *cols):
    return table(spark, sf, "embeddings").select("vec_id", *cols, F.col("embedding").cast("array<double>").alias("vec"))


@query("pca_template", "D2")
def pca_template(spark, sf):
    """Template: mean per (label, cell), z-scored per cell over labels, principal axes of it."""
    m = zscore(group_mean(emb_long(spark, sf), ["label", "parcel"], "value", "v"), ["parcel"], "v")
    rows = AX.pack_rows(m, ["label"], "parcel", "z", list(range(WIDTH)))
    comp = AX.pca(rows, [], "vec", WIDTH, 5)
    return rounded(AX.pca_scores(rows, comp, [], ["label"], "vec"))


@query("pca_by_subject", "D4 D7")
def pca_by_subject(spark, sf):
    return rounded(AX.explained_variance(vectors(spark, sf, "label"), ["label"], "vec", WIDTH, 10))


@query(
    "explained_variance_total",
    "D7 A17",
    f"WITH {EMB} SELECT label, {R('sum(v)', 7)} AS total FROM (SELECT label, parcel, var_samp(value) AS v FROM emb GROUP BY 1, 2) GROUP BY 1",
)
def explained_variance_total(spark, sf):
    """Eigenvalues of every subject sum to its total variance."""
    c = AX.pca(vectors(spark, sf, "label"), ["label"], "vec", WIDTH, WIDTH)
    return rounded(c.groupBy("label").agg(F.sum("eigenvalue").alias("total")), 7)


def subject_scores(spark, sf):
    """Scores (subject = label, parcel = cell, component = quarter of the label's vectors)."""
    e = emb_long(spark, sf).withColumn("comp", (F.col("vec_id") % 4 + 1).cast("int"))
    return e.groupBy("label", "parcel", "comp").agg(F.avg("value").alias("score"))


@query("align_sign", "D5")
def align_sign(spark, sf):
    s = subject_scores(spark, sf)
    ref = s.groupBy("parcel", "comp").agg(F.avg("score").alias("score"))
    signs = AX.align_sign(s, ref, "label", "parcel")
    return rounded(AX.apply_signs(s, signs, "label").select("label", "parcel", "comp", "score"))


@query("align_procrustes", "D6")
def align_procrustes(spark, sf):
    s = AX.pack_rows(subject_scores(spark, sf), ["label", "parcel"], "comp", "score", [1, 2, 3, 4])
    ref = s.groupBy("parcel").agg(F.array(*[F.avg(F.col("vec")[i]) for i in range(4)]).alias("vec"))
    rot = AX.align_procrustes(s, ref, "label", "parcel", 4)
    return rounded(rot.select("label", F.posexplode("rotation").alias("cell", "value")))


@query(
    "anchor_sign",
    "D3 A3a",
    f"WITH {EMB}, sc AS (SELECT parcel, CAST(vec_id % 4 + 1 AS INTEGER) AS comp, avg(value) AS score FROM emb GROUP BY 1, 2), sec AS (SELECT parcel, CAST(floor(stddev_pop(value) * 1000) AS BIGINT) % 5 AS section FROM emb GROUP BY 1), "
    "f AS (SELECT CASE WHEN avg(score) < 0 THEN -1.0 ELSE 1.0 END AS f FROM sc JOIN sec USING (parcel) WHERE comp = 1 AND section = 2) "
    f"SELECT parcel, comp, {R('CASE WHEN comp = 1 THEN score * f ELSE score END')} AS score FROM sc, f",
)
def anchor_sign(spark, sf):
    e = emb_long(spark, sf).withColumn("comp", (F.col("vec_id") % 4 + 1).cast("int"))
    sc = e.groupBy("parcel", "comp").agg(F.avg("value").alias("score"))
    return rounded(AX.anchor_sign(sc, sections(spark, sf), "parcel", "section", 2))


_PAIR = (
    "v AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings), ij AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM range(0, 64) a(i), range(0, 64) b(j)), "
    "c AS (SELECT label, i, j, count(*) AS n, covar_samp(v[i + 1], v[j + 1]) AS cov, corr(v[i + 1], v[j + 1]) AS r, sum(v[i + 1] * v[j + 1]) AS xy, sum(v[i + 1] * v[i + 1]) AS xx, sum(v[j + 1] * v[j + 1]) AS yy FROM v, ij GROUP BY 1, 2, 3)"
)


def _similarity_query(metric: str, expr: str, digits: int):
    @query(
        f"similarity_{metric}",
        "P1",
        f"WITH {_PAIR} SELECT label, n, i AS f1, j AS f2, {R(expr, digits)} AS s FROM c WHERE i <= j",
    )
    def run(spark, sf):
        s = D.similarity(vectors(spark, sf, "label"), ["label"], "vec", WIDTH, metric)
        return rounded(D.similarity_cells(s, ["label", "n"], WIDTH), digits)

    return run


_similarity_query("cov", "cov", 8)
_similarity_query("corr", "CASE WHEN i = j THEN 0 ELSE atanh(r) END", 6)
_similarity_query("cosine", "xy / sqrt(xx * yy)", 6)
_similarity_query("euc", "sqrt(greatest(xx + yy - 2 * xy, 0))", 5)


@query("participation_ratio_cov", "P2 F10", f"WITH {_PAIR} SELECT label, any_value(n) AS n, {R('pow(sum(cov) FILTER (i = j), 2) / sum(cov * cov)', 5)} AS pr FROM c GROUP BY 1")
def participation_ratio_cov(spark, sf):
    return rounded(D.participation_ratio(vectors(spark, sf, "label"), ["label"], "vec", WIDTH, "cov"), 5)


@query("participation_ratio_cosine", "P2", f"WITH {_PAIR}, s AS (SELECT label, n, i, j, xy / sqrt(xx * yy) AS s FROM c) SELECT label, any_value(n) AS n, {R('pow(sum(s) FILTER (i = j), 2) / sum(s * s)', 5)} AS pr FROM s GROUP BY 1")
def participation_ratio_cosine(spark, sf):
    return rounded(D.participation_ratio(vectors(spark, sf, "label"), ["label"], "vec", WIDTH, "cosine"), 5)


@query("participation_ratio_corr", "P2")
def participation_ratio_corr(spark, sf):
    return rounded(D.participation_ratio(vectors(spark, sf, "label"), ["label"], "vec", WIDTH, "corr"), 5)


@query("group_similarity", "P4", f"WITH {_PAIR} SELECT i AS f1, j AS f2, {R('avg(cov)', 8)} AS s FROM c WHERE i <= j GROUP BY 1, 2")
def group_similarity(spark, sf):
    s = D.similarity(vectors(spark, sf, "label"), ["label"], "vec", WIDTH, "cov")
    return rounded(D.similarity_cells(D.group_similarity(s, []), [], WIDTH), 8)


@query(
    "similarity_distance",
    "X6 P4",
    f"WITH {_PAIR}, s AS (SELECT i, j, avg(cov) AS s FROM c GROUP BY 1, 2), b AS (SELECT min(s) AS lo, max(s) AS hi FROM s) SELECT i AS f1, j AS f2, CASE WHEN i = j THEN 0.0 ELSE {R('1 - (s - lo) / (hi - lo)')} END AS d FROM s, b WHERE i <= j",
)
def similarity_distance(spark, sf):
    from cohortloom.functions.scalar import similarity_to_distance

    s = D.similarity(vectors(spark, sf, "label"), ["label"], "vec", WIDTH, "cov")
    c = D.similarity_cells(D.group_similarity(s, []), [], WIDTH)
    j = join_stats(c, c.agg(F.min("s").alias("lo"), F.max("s").alias("hi")), [])
    return rounded(j.select("f1", "f2", similarity_to_distance("s", "lo", "hi", F.col("f1") == F.col("f2")).alias("d")))


@query(
    "region_set_pr",
    "P10 H6",
    "WITH v AS (SELECT vec_id % 20 AS subject, label AS region, embedding::DOUBLE[] AS v FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY 1 HAVING avg(embedding[1]) > 0)), "
    "ij AS (SELECT i, j FROM range(0, 64) a(i), range(0, 64) b(j)), "
    "c AS (SELECT subject, region, i, j, sum(v[i + 1] * v[j + 1]) / sqrt(sum(v[i + 1] * v[i + 1]) * sum(v[j + 1] * v[j + 1])) AS s FROM v, ij GROUP BY 1, 2, 3, 4), "
    "m AS (SELECT subject, i, j, avg(s) AS s FROM c GROUP BY 1, 2, 3), p AS (SELECT subject, pow(sum(s) FILTER (i = j), 2) / sum(s * s) AS pr FROM m GROUP BY 1), "
    "g AS (SELECT count(*) FILTER (subject < 10) AS n1, count(*) FILTER (subject >= 10) AS n2, avg(pr) FILTER (subject < 10) AS mean1, avg(pr) FILTER (subject >= 10) AS mean2, var_samp(pr) FILTER (subject < 10) AS v1, var_samp(pr) FILTER (subject >= 10) AS v2 FROM p), "
    "t AS (SELECT *, CAST(n1 + n2 - 2 AS DOUBLE) AS df, (mean1 - mean2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t FROM g) "
    f"SELECT n1, n2, {R('mean1', 5)} AS mean1, {R('mean2', 5)} AS mean2, df, {R('t', 4)} AS t, {R('2 * ' + t_tail_sql('t', 'df'), 4)} AS p FROM t",
)
def region_set_pr(spark, sf):
    v = vectors(spark, sf, F.col("label").alias("region")).withColumn("subject", F.col("vec_id") % 20)
    sims = D.similarity(v, ["subject", "region"], "vec", WIDTH, "cosine")
    regions = v.groupBy("region").agg(F.avg(F.col("vec")[0]).alias("m")).filter("m > 0").select("region")
    groups = v.select("subject").distinct().withColumn("grp", (F.col("subject") < 10).cast("int"))
    _, t = D.region_set_pr(sims, regions, "subject", "region", "cosine", groups, "grp", 1, 0)
    return rounded(t, 5, t=4, p=4)


@query(
    "transmodal_t",
    "P8 A3b H6",
    f"WITH {EMB}, {_NET}, s AS (SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS grp, avg(value) FILTER (network >= 10) AS trans FROM emb JOIN net USING (parcel) GROUP BY 1, 2), "
    "g AS (SELECT count(*) FILTER (grp = 1) AS n1, count(*) FILTER (grp = 0) AS n2, avg(trans) FILTER (grp = 1) AS mean1, avg(trans) FILTER (grp = 0) AS mean2, var_samp(trans) FILTER (grp = 1) AS v1, var_samp(trans) FILTER (grp = 0) AS v2 FROM s), "
    "t AS (SELECT *, CAST(n1 + n2 - 2 AS DOUBLE) AS df, (mean1 - mean2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t FROM g) "
    f"SELECT n1, n2, {R('mean1')} AS mean1, {R('mean2')} AS mean2, df, {R('t', 4)} AS t, {R('2 * ' + t_tail_sql('t', 'df'), 4)} AS p FROM t",
)
def transmodal_t(spark, sf):
    e = design(spark, sf).join(networks(spark, sf).filter("network >= 10"), "parcel")
    s = e.groupBy("vec_id", "grp").agg(F.avg("value").alias("trans"))
    return rounded(S.two_sample_t(s, [], "grp", 1, 0, "trans"), 6, t=4, p=4)


@query("prepared_weights", "P3 A16 L4 L3 W5")
def prepared_weights(spark, sf):
    """Chain: delays pooled, frequency regressed out, ancestors added, z-scored per cell."""
    from cohortloom.operators.hierarchy import ancestors
    from cohortloom.sources.tables import split_delay

    w = split_delay(emb_long(spark, sf), ["vec_id", "label"], "parcel", 16, "value").withColumnRenamed("feature_id", "feature")
    w = w.withColumnsRenamed({"vec_id": "subject", "label": "parcel"})
    freq = w.groupBy("feature").agg(F.count_if(F.col("value") > 0.1).alias("freq"))
    vocab = w.select("feature").distinct()
    tree = vocab.filter("feature > 0").select(F.col("feature").alias("child"), F.floor(F.col("feature") / 2).cast("int").alias("parent"))
    out = D.prepare_weights(
        w, "subject", "parcel", "feature", "value", delay="delay_id", pool="max", frequency=(freq, "freq"), hierarchy=(ancestors(tree), vocab), standardise=True
    )
    return rounded(out)


@query("ward_features", "P5 P7")
def ward_features(spark, sf):
    s = D.similarity(vectors(spark, sf, "label"), ["label"], "vec", WIDTH, "cosine")
    m = CL.cluster_members(CL.ward(s, ["label"], WIDTH, 4), ["label"], "f", "cluster")
    return m.select("label", "cluster", F.concat_ws(",", F.col("members").cast("array<string>")).alias("members"), "n")


SCAN = range(2, 8)


@query("ward_scan", "P5 P6")
def ward_scan(spark, sf):
    """Ward clusters of the features of each label for every k of one dendrogram, with their mean silhouette."""
    sims = cut(D.similarity(vectors(spark, sf, "label"), ["label"], "vec", WIDTH, "cosine"))
    labels = cut(CL.ward_scan(CL.ward_tree(sims, ["label"], WIDTH), ["label"], WIDTH, SCAN))
    sil = CL.stored_silhouette(CL.distance_cells(sims, ["label"], WIDTH), labels, ["label"])
    mean = sil.groupBy("label", "k").agg(F.countDistinct("cluster").alias("n_clusters"), F.avg("silhouette").alias("silhouette"))
    best = argmax_by(mean, ["label"], "silhouette", "k", "k").select("label", F.col("k").alias("best"))
    return rounded(mean.join(best, "label").select("label", "k", "n_clusters", "silhouette", (F.col("k") == F.col("best")).alias("selected")), 5)


@query(
    "stored_silhouette",
    "P6",
    f"WITH {EMB}, s AS (SELECT a.label, a.parcel AS f1, b.parcel AS f2, sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)) AS s FROM emb a JOIN emb b ON a.vec_id = b.vec_id AND a.label = b.label GROUP BY 1, 2, 3), "
    "w AS (SELECT *, min(s) OVER (PARTITION BY label) AS lo, max(s) OVER (PARTITION BY label) AS hi FROM s), d AS (SELECT label, f1, f2, 1 - (s - lo) / (hi - lo) AS d FROM w WHERE f1 <> f2), "
    "k AS (SELECT CAST(unnest(range(2, 5)) AS INTEGER) AS k), m AS (SELECT label, k, f1, f2 % k AS other, f1 % k AS cluster, avg(d) AS m FROM d, k GROUP BY ALL), "
    "g AS (SELECT label, k, f1, cluster, max(m) FILTER (other = cluster) AS a, min(m) FILTER (other <> cluster) AS b FROM m GROUP BY ALL) "
    f"SELECT label, k, CAST(f1 AS INTEGER) AS f, CAST(cluster AS INTEGER) AS cluster, {R('(b - a) / greatest(a, b)', 5)} AS silhouette FROM g",
)
def stored_silhouette(spark, sf):
    """Silhouette from stored distances for given clusters: the remainder of a feature's number."""
    sims = D.similarity(vectors(spark, sf, "label"), ["label"], "vec", WIDTH, "cosine")
    ids = sims.select("label", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("f")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (2, 3, 4)])))
    labels = ids.withColumn("cluster", (F.col("f") % F.col("k")).cast("int"))
    return rounded(CL.stored_silhouette(CL.distance_cells(sims, ["label"], WIDTH), labels, ["label"]), 5)


_SIL = (
    "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT label, count(*) AS m FROM e GROUP BY 1), "
    "d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS s FROM e a, e b GROUP BY 1, 2, 3), "
    "g AS (SELECT vec_id, d.label, max(s / (m - 1)) FILTER (d.label = other) AS a, min(s / m) FILTER (d.label <> other) AS b FROM d JOIN n ON n.label = other GROUP BY 1, 2)"
)


@query("silhouette", "B4 P6", f"WITH {_SIL} SELECT vec_id, label, {R('(b - a) / greatest(a, b)')} AS silhouette FROM g")
def silhouette(spark, sf):
    return rounded(CL.silhouette(vectors(spark, sf, "label"), "vec_id", "vec", "label"))


@query(
    "cluster_validity",
    "P6",
    f"WITH {EMB}, c AS (SELECT label, parcel, avg(value) AS c, count(*) AS n, var_pop(value) AS vp FROM emb GROUP BY 1, 2), g AS (SELECT parcel, avg(value) AS g FROM emb GROUP BY 1), "
    "q AS (SELECT sum(n * pow(c - g, 2)) AS between, sum(n * vp) AS within, count(DISTINCT label) AS k FROM c JOIN g USING (parcel)), nn AS (SELECT count(*) AS n FROM embeddings), "
    "sp AS (SELECT label, avg(s) AS s FROM (SELECT vec_id, label, sqrt(sum(pow(value - c, 2))) AS s FROM emb JOIN c USING (label, parcel) GROUP BY 1, 2) GROUP BY 1), "
    "cd AS (SELECT a.label AS i, b.label AS j, sqrt(sum(pow(a.c - b.c, 2))) AS d FROM c a JOIN c b ON a.parcel = b.parcel AND a.label <> b.label GROUP BY 1, 2), "
    "db AS (SELECT avg(m) AS db FROM (SELECT i, max((x.s + y.s) / d) AS m FROM cd JOIN sp x ON x.label = i JOIN sp y ON y.label = j GROUP BY 1)) "
    f"SELECT CAST(k AS INTEGER) AS k, {R('between / (k - 1) / (within / (n - k))', 5)} AS calinski_harabasz, {R('db', 5)} AS davies_bouldin FROM q, nn, db",
)
def cluster_validity(spark, sf):
    return rounded(CL.cluster_validity(vectors(spark, sf, "label"), "vec", "label", WIDTH), 5)


@query("knee", "P6 B4", "WITH v AS (SELECT l_linenumber AS k, 1000.0 / l_linenumber + avg(l_discount) AS v FROM lineitem GROUP BY 1), e AS (SELECT arg_min(v, k) AS v0, arg_max(v, k) AS v1 FROM v) SELECT k AS knee FROM v, e ORDER BY v0 + (v1 - v0) * (k - 1) / 6 - v DESC LIMIT 1")
def knee(spark, sf):
    v = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.avg("l_discount").alias("d"))
    return CL.knee(v.select("k", (F.lit(1000.0) / F.col("k") + F.col("d")).alias("v")), "k", "v")


@query("consensus_k", "P6", "SELECT CAST(greatest(3, round(avg(p_size % 9 + 2))) AS INTEGER) AS k FROM part")
def consensus_k(spark, sf):
    return CL.consensus_k(table(spark, sf, "part").select((F.col("p_size") % 9 + 2).alias("k")), "k", 3)


PROFILE = ["v0", "v1", "v2", "v3", "v4", "v5"]


def profiles(spark, sf):
    """Six-variable profiles: every variable is the mean of each sixth cell of a vector, z-scored over all rows."""
    every = lambda i: F.filter("embedding", lambda x, j: j % 6 == i)
    mean = lambda i: F.aggregate(every(i), F.lit(0.0), lambda a, x: a + x) / len(range(i, WIDTH, 6))
    e = table(spark, sf, "embeddings").select("vec_id", "label", *[mean(i).alias(f"v{i}") for i in range(6)])
    s = e.agg(*[f(c).alias(f"_{n}_{c}") for c in PROFILE for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    j = join_stats(e, s, [])
    return j.select("vec_id", "label", *[((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(c) for c in PROFILE])


PROF = (
    "r0 AS (SELECT vec_id, label, " + ", ".join("(" + " + ".join(f"CAST(embedding[{j + 1}] AS DOUBLE)" for j in range(i, WIDTH, 6)) + f") / {len(range(i, WIDTH, 6))} AS v{i}" for i in range(6)) + " FROM embeddings), "
    "pf AS (SELECT vec_id, label, " + ", ".join(f"(v{i} - avg(v{i}) OVER ()) / stddev_pop(v{i}) OVER () AS v{i}" for i in range(6)) + " FROM r0)"
)
_MEAN6 = "(v0 + v1 + v2 + v3 + v4 + v5) / 6"


@query("profile_center", "B1", f"WITH {PROF} SELECT vec_id, " + ", ".join(f"{R(f'v{i} - {_MEAN6}')} AS v{i}" for i in range(6)) + " FROM pf")
def profile_center(spark, sf):
    return rounded(CL.profile_center(profiles(spark, sf), PROFILE).drop("label"))


@query("outlier_flags", "B2", f"WITH {PROF} SELECT vec_id, " + ", ".join(f"CAST(abs(v{i}) > 1.0 AS INTEGER) AS v{i}" for i in range(6)) + " FROM pf")
def outlier_flags(spark, sf):
    return CL.outlier_flags(profiles(spark, sf), PROFILE, 1.0).drop("label")


@query("kmeans_scan", "B3 B4")
def kmeans_scan(spark, sf):
    """Best of fifty starts for two to five clusters, with inertia and silhouette."""
    d = CL.profile_center(profiles(spark, sf), PROFILE).select("vec_id", *PROFILE)
    labels, inertia = CL.kmeans_scan(d, "vec_id", PROFILE)
    wide = labels.groupBy("vec_id").pivot("k", [2, 3, 4, 5]).agg(F.first("cluster"))
    v = cut(d.select("vec_id", F.array(*PROFILE).alias("vec")).join(wide, "vec_id"))
    each = CL.silhouettes(v, "vec_id", "vec", {str(k): F.col(str(k)) for k in (2, 3, 4, 5)})
    sil = each.groupBy(F.col("name").cast("int").alias("k")).agg(F.avg("silhouette").alias("silhouette"))
    sizes = labels.groupBy("k").agg(F.count("*").alias("n"))
    return rounded(sizes.join(inertia, "k").join(sil, "k"), 3)


