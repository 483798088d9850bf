"""Cross-validated prediction and model comparison on the embedding vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.scalar import key_hash
from cohortloom.operators import compare as M
from cohortloom.operators import predict as P
from cohortloom.operators.nulls import permutation_p, permuted_places
from cohortloom.plans.catalog import R, key_hash_sql, query, rounded, t_tail_sql, table
from cohortloom.plans.stats_queries import _BH
from cohortloom.session import cut

SET_A = tuple(f"a{i}" for i in range(8))
SET_B = tuple(f"b{i}" for i in range(8))
LAYOUT = P.Layout(
    covariates=("grp", "age"),
    features=(*SET_A, *SET_B),
    items=("y1", "y2"),
    models={"combined": SET_A + SET_B, "a": SET_A, "b": SET_B},
    group="grp",
    adjust=("age",),
)


def subjects(spark, sf):
    """Row vector in layout order: group, covariate, two sets of eight cells, two outcomes."""
    e = table(spark, sf, "embeddings")
    v = lambda i: F.col("embedding")[i].cast("double")
    y1 = F.col("label").cast("double")
    y2 = v(0) + v(9) * 0.5 + (F.col("vec_id") % 11) / 40
    vec = F.array((F.col("label") < 5).cast("double"), (F.col("vec_id") % 7).cast("double"), *[v(i) for i in range(16)], y1, y2)
    return e.select("vec_id", vec.alias("vec"))


@query(
    "repeat_folds",
    "Q1",
    "WITH g AS (SELECT vec_id, CAST(unnest(range(0, 4)) AS INTEGER) AS rep FROM embeddings), "
    f"h AS (SELECT *, rank() OVER (PARTITION BY rep ORDER BY {key_hash_sql('vec_id', 'rep', '42')}) - 1 AS p FROM g) SELECT vec_id, rep, CAST(p % 5 AS INTEGER) AS fold, CAST((p // 5) % 5 AS INTEGER) AS part FROM h",
)
def repeat_folds(spark, sf):
    return P.repeat_folds(table(spark, sf, "embeddings"), "vec_id", 4, 5)


def parts(spark, sf, n_rep, k, halves=False):
    rows = subjects(spark, sf)
    folds = cut(P.repeat_folds(rows, "vec_id", n_rep, k, halves=halves))
    cells = P.fold_table(rows, folds, "vec_id", LAYOUT)
    return rows, folds, cut(P.training_parts(cut(cells)))


@query("fold_select", "Q2 D9")
def fold_select(spark, sf):
    _, _, p = parts(spark, sf, 3, 4)
    s = P.fold_select(p, LAYOUT, alpha=0.3)
    return s.select("rep", "fold", F.concat_ws(",", "selected").alias("selected"), F.size("selected").alias("n"))


@query("valid_repetitions", "Q2")
def valid_repetitions(spark, sf):
    """Two repetitions of four folds, drawn in waves until both select a feature of each set everywhere."""
    valid, _ = P.draw_repetitions(subjects(spark, sf), "vec_id", LAYOUT, 4, ["a", "b"], 1, 2, alpha=0.6)
    return valid


@query("selected_enet", "Q2 Q3 Q4 Q5")
def selected_enet(spark, sf):
    """Elastic net on the features that each fold selected, in valid repetitions only."""
    rows = subjects(spark, sf)
    valid, selected = P.draw_repetitions(rows, "vec_id", LAYOUT, 4, ["a", "b"], 1, 2, alpha=0.6)
    last = valid.agg(F.max("rep")).first()[0]
    folds = cut(P.repeat_folds(rows, "vec_id", last + 1, 4).join(valid, "rep", "left_semi"))
    p = cut(P.training_parts(cut(P.fold_table(rows, folds, "vec_id", LAYOUT))))
    fits = cut(P.enet_cv(p, LAYOUT, selected, n_alphas=30))
    m = P.cv_metrics(P.cv_predictions(rows, folds, fits, "vec_id"), ["item", "model", "rep"])
    return rounded(P.summarise(m, ["item", "model"]), 4)


def predictions(spark, sf, n_rep=2, k=4, halves=False, alphas=30):
    rows, folds, p = parts(spark, sf, n_rep, k, halves)
    fits = cut(P.enet_cv(p, LAYOUT, n_alphas=alphas))
    return P.cv_predictions(rows, folds, fits, "vec_id")


@query("enet_cv", "Q3 Q4 Q5 Q6 Q7 Q8")
def enet_cv(spark, sf):
    """Repeated folds, three feature sets, adjusted outcomes; mean and deviation over repetitions."""
    m = P.cv_metrics(predictions(spark, sf), ["item", "model", "rep"])
    return rounded(P.summarise(m, ["item", "model"]), 4)


@query(
    "cv_metrics",
    "Q7 Q8",
    "WITH p AS (SELECT l_returnflag AS rep, l_linenumber AS item, l_extendedprice AS y, l_quantity * 2000 AS y_hat FROM lineitem), "
    "m AS (SELECT item, rep, corr(y, y_hat) AS r, 1 - sum(pow(y - y_hat, 2)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - y_hat)) AS mae FROM p GROUP BY 1, 2) "
    f"SELECT item, {R('avg(r)')} AS mean_r, {R('stddev_pop(r)')} AS sd_r, {R('avg(r2)')} AS mean_r2, {R('stddev_pop(r2)')} AS sd_r2, {R('avg(mae)', 3)} AS mean_mae, {R('stddev_pop(mae)', 3)} AS sd_mae FROM m GROUP BY 1",
)
def cv_metrics(spark, sf):
    p = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("rep"), F.col("l_linenumber").alias("item"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("y_hat")
    )
    return rounded(P.summarise(P.cv_metrics(p, ["item", "rep"]), ["item"]), 6, mean_mae=3, sd_mae=3)


@query(
    "item_p",
    "Q8 H11",
    "WITH p AS (SELECT model, l_linenumber AS item, l_extendedprice AS y, CASE WHEN model = 'quantity' THEN l_quantity ELSE l_tax END AS h FROM lineitem, (VALUES ('quantity'), ('tax')) m(model)), "
    "r AS (SELECT model, item, count(*) AS n, corr(y, h) AS r FROM p GROUP BY 1, 2), "
    "t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, CAST(n - 2 AS DOUBLE) AS df FROM r), "
    f"v AS (SELECT *, CASE WHEN t >= 0 THEN {t_tail_sql('t', 'df')} ELSE 1 - {t_tail_sql('t', 'df')} END AS p FROM t), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p) AS k, count(*) OVER (PARTITION BY model) AS m FROM v) "
    f"SELECT model, item, n, {R('r', 5)} AS r, {R('t', 3)} AS t, {R('p', 4)} AS p, {R('least(1.0, min(p * m / k) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING))', 4)} AS p_adj FROM k",
)
def item_p(spark, sf):
    """One-sided p of each item's correlation under two models, adjusted over the items of a model."""
    li = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("item"), F.col("l_extendedprice").alias("y"), "l_quantity", "l_tax")
    pred = li.withColumn("_m", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).cast("double").alias("y_hat")) for n, c in (("quantity", "l_quantity"), ("tax", "l_tax"))])))
    return rounded(P.item_p(pred.select("item", "y", "_m.*"), ["model"], "item"), 4, r=5, t=3)


@query("outcome_permutation", "N5 Q5")
def outcome_permutation(spark, sf):
    """1,000 shuffled outcomes against the observed held-out correlation. The rows' cross-products are made once; a
    permutation is one column of the products with the outcome."""
    rows = subjects(spark, sf)
    y = rows.select("vec_id", F.element_at("vec", -1).alias("y"))
    moved, place = permuted_places(y, "vec_id", "y", 1000, 3)
    place = cut(place)
    own = y.join(place.hint("merge"), "vec_id").select(F.lit(-1).alias("perm"), "y", "_pos")
    folds = cut(P.repeat_folds(rows, "vec_id", 1, 4))
    layout = P.Layout(LAYOUT.covariates, LAYOUT.features, LAYOUT.items, {"combined": LAYOUT.features}, None, LAYOUT.adjust)
    cells = cut(P.fold_table(rows, folds, "vec_id", layout)).drop("rep")
    # Outcomes are packed by position before they meet the row there: one shuffle of single outcomes less.
    packed = P.outcome_blocks(rows, moved.unionByName(own), "_pos")
    blocks = cut(packed.hint("merge").join(place.hint("merge"), "_pos").drop("_pos"))
    sums = cut(P.outcome_sums(rows, folds.drop("rep"), blocks, "vec_id", layout))
    r = cut(P.permuted_scores(cells, sums, layout, n_alphas=20))
    return rounded(permutation_p(r.filter("perm >= 0"), r.filter("perm < 0").select("r")), 4)


@query("split_half_sharp", "Q9 Q10")
def split_half_sharp(spark, sf):
    """Split-half repetitions, differences between models, score test per item and pair."""
    m = P.cv_metrics(predictions(spark, sf, 4, 3, halves=True, alphas=20), ["item", "model", "rep"])
    d = M.model_differences(m, ["item", "rep"])
    halves = M.split_half_cv(d, ["item", "pair", "alternative"])
    return rounded(M.sharp_test(halves, ["item", "pair", "alternative"]), 3)


def half_differences(spark, sf):
    """Differences of two halves per repetition, straight from the order lines: item = line number,
    repetition = supplier."""
    li = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("item"), F.col("l_suppkey").alias("rep"), "l_orderkey", "l_discount", "l_tax")
    diff = F.avg(F.when(key_hash("l_orderkey", 3) % 2 == 0, F.col("l_discount") - F.col("l_tax"))).alias("d_a")
    other = F.avg(F.when(key_hash("l_orderkey", 3) % 2 == 1, F.col("l_discount") - F.col("l_tax"))).alias("d_b")
    return li.groupBy("item", "rep").agg(diff, other).filter("d_a is not null and d_b is not null")


_HALF = (
    f"hd AS (SELECT l_linenumber AS item, l_suppkey AS rep, avg(l_discount - l_tax) FILTER ({key_hash_sql('l_orderkey', '3')} % 2 = 0) AS d_a, avg(l_discount - l_tax) FILTER ({key_hash_sql('l_orderkey', '3')} % 2 = 1) AS d_b FROM lineitem GROUP BY 1, 2), "
    "h AS (SELECT * FROM hd WHERE d_a IS NOT NULL AND d_b IS NOT NULL)"
)
# Likelihood over a fixed fine grid of rho; rounded coarsely because the library refines further.
_SHARP = (
    "s AS (SELECT item, count(*) AS j, avg((d_a + d_b) / 2) AS m, sum(pow(d_a - d_b, 2)) / 2 AS qa, var_pop(d_a + d_b) * count(*) / 2 AS qs FROM h GROUP BY 1), "
    "g AS (SELECT *, -1.0 / (2 * j - 1) + 1e-4 + (0.5 - 1e-4 + 1.0 / (2 * j - 1) - 1e-4) * i / 40000.0 AS rho FROM s, range(0, 40001) t(i)), "
    "c AS (SELECT *, qa + qs / (1 - 2 * rho) + 2 * j * m * m / (1 + 2 * (j - 1) * rho) AS q FROM g), "
    "b AS (SELECT item, any_value(j) AS j, any_value(m) AS m, arg_min(rho, j * ln(q) + 0.5 * ((j - 1) * ln(1 - 2 * rho) + ln(1 + 2 * (j - 1) * rho))) AS rho, arg_min(q, j * ln(q) + 0.5 * ((j - 1) * ln(1 - 2 * rho) + ln(1 + 2 * (j - 1) * rho))) AS q FROM c GROUP BY 1)"
)


@query(
    "sharp_test",
    "Q10",
    f"WITH {_HALF}, {_SHARP} SELECT item, j AS n_rep, {R('m', 5)} AS mean_diff, {R('m / sqrt(q / (2 * j) * (1 / (2.0 * j) + (j - 1.0) / j * rho))', 1)} AS z FROM b",
)
def sharp_test(spark, sf):
    s = M.sharp_test(half_differences(spark, sf), ["item"])
    return rounded(s.select("item", "n_rep", "mean_diff", "z"), 5, z=1)


def rep_differences(spark, sf):
    d = half_differences(spark, sf)
    return d.select("item", "rep", F.explode(F.array(
        F.struct(F.lit("combined_vs_a").alias("pair"), F.lit("greater").alias("alternative"), (F.col("d_a") - 0.0105).alias("d")),
        F.struct(F.lit("combined_vs_b").alias("pair"), F.lit("greater").alias("alternative"), (F.col("d_b") - 0.0095).alias("d")),
        F.struct(F.lit("a_vs_b").alias("pair"), F.lit("two-sided").alias("alternative"), (F.col("d_a") - F.col("d_b")).alias("d")),
    )).alias("_p")).select("item", "rep", "_p.*")


_REP = (
    f"{_HALF}, rd AS (SELECT item, rep, 'combined_vs_a' AS pair, 'greater' AS alternative, d_a - 0.0105 AS d FROM h UNION ALL SELECT item, rep, 'combined_vs_b', 'greater', d_b - 0.0095 FROM h UNION ALL SELECT item, rep, 'a_vs_b', 'two-sided', d_a - d_b FROM h)"
)
_CT = (
    "ct0 AS (SELECT item, pair, alternative, count(*) AS n, avg(d) AS mean_diff, avg(d) / sqrt((1.0 / count(*) + 1.0 / 9) * var_samp(d)) AS t FROM rd GROUP BY 1, 2, 3), "
    f"ct1 AS (SELECT *, 2 * {t_tail_sql('t', 'CAST(n - 1 AS DOUBLE)')} AS p2 FROM ct0), ct AS (SELECT item, pair, alternative, n, mean_diff, t, CASE WHEN alternative = 'greater' THEN CASE WHEN t > 0 THEN p2 / 2 ELSE 1 - p2 / 2 END ELSE p2 END AS p FROM ct1)"
)


@query("corrected_t", "Q11 X7", f"WITH {_REP}, {_CT} SELECT item, pair, alternative, n, {R('mean_diff')} AS mean_diff, {R('t', 5)} AS t, {R('p', 5)} AS p FROM ct")
def corrected_t(spark, sf):
    return rounded(M.corrected_t(rep_differences(spark, sf), ["item", "pair", "alternative"], 10), 6, t=5, p=5)


@query("model_differences", "Q6 Q9", "WITH m AS (SELECT l_suppkey AS rep, avg(l_discount) AS c, avg(l_tax) AS a, avg(l_quantity) / 500 AS b FROM lineitem GROUP BY 1) "
    f"SELECT rep, 'combined_vs_a' AS pair, 'greater' AS alternative, {R('c - a')} AS d FROM m UNION ALL SELECT rep, 'combined_vs_b', 'greater', {R('c - b')} FROM m UNION ALL SELECT rep, 'a_vs_b', 'two-sided', {R('a - b')} FROM m")
def model_differences(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("rep")).agg(F.avg("l_discount").alias("combined"), F.avg("l_tax").alias("a"), (F.avg("l_quantity") / 500).alias("b"))
    return rounded(M.model_differences(g.unpivot(["rep"], ["combined", "a", "b"], "model", "r"), ["rep"]))


@query(
    "compare_models",
    "Q12 H11",
    f"WITH {_REP}, {_CT}, pv AS (SELECT * FROM ct), {_BH.format(f='PARTITION BY 1')} SELECT item, pair, alternative, {R('t', 5)} AS t, {R('p', 5)} AS corrected_p, {R('adj', 5)} AS corrected_p_adj FROM a",
)
def compare_models(spark, sf):
    """Both tests per item and pair; the score test is checked on its own, so its columns stay out."""
    d = rep_differences(spark, sf)
    keys = ["item", "pair", "alternative"]
    halves = d.withColumn("rep", F.col("rep"))
    sharp = M.sharp_test(M.split_half_cv(halves, keys).filter("d_a is not null and d_b is not null"), keys)
    out = M.compare_models(sharp, M.corrected_t(d, keys, 10), keys)
    return rounded(out.select(*keys, "t", "corrected_p", "corrected_p_adj"), 5)


_ITEM = f"{_REP}, im AS (SELECT item, pair, avg(d) AS d FROM rd GROUP BY 1, 2)"


@query(
    "cross_item_trend",
    "Q13 H9 H10",
    f"WITH {_ITEM} SELECT pair, count(*) AS n_items, {R('avg(d)')} AS mean_diff, count(*) FILTER (d > 0) AS n_pos, count(*) FILTER (d < 0) AS n_neg, {R('coalesce(sum(rk) FILTER (d > 0), 0)', 1)} AS w_plus, CASE WHEN pair = 'a_vs_b' THEN 'two-sided' ELSE 'greater' END AS alternative "
    "FROM (SELECT *, rank() OVER (PARTITION BY pair ORDER BY abs(d)) AS rk FROM im) GROUP BY 1",
)
def cross_item_trend(spark, sf):
    im = rep_differences(spark, sf).groupBy("item", "pair").agg(F.avg("d").alias("d"))
    return rounded(M.cross_item_trend(im, "pair", "d").select("pair", "n_items", "mean_diff", "n_pos", "n_neg", "w_plus", "alternative"), 6, w_plus=1)


@query("cross_item_p", "Q13 H9 H10 H11")
def cross_item_p(spark, sf):
    im = rep_differences(spark, sf).groupBy("item", "pair").agg(F.avg("d").alias("d"))
    return rounded(M.cross_item_trend(im, "pair", "d").select("pair", "sign_p", "sign_p_adj", "wilcoxon_p", "wilcoxon_p_adj"))


@query("per_rep_rate", "Q14 H10")
def per_rep_rate(spark, sf):
    return rounded(M.per_rep_rate(rep_differences(spark, sf), "rep", "pair", "d"))


