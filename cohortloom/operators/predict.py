"""Repeated cross-validated elastic net with fold-wise feature selection.

All fits of all folds come from one table of cross-products per (repetition, fold, part). Inner
folds are the parts, so training sums of any inner or outer split are sums of table rows.
Column order of a row vector: covariates, features, outcomes. With the augmented 1 in front.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from cohortloom.functions import tails
from cohortloom.functions.scalar import corr_or_zero, key_hash
from cohortloom.functions.small import unpack
from cohortloom.functions.tails import t_sf
from cohortloom.operators.gram import check_width, gram_wide, map_rows, sum_grams
from cohortloom.operators.ordering import rank_table
from cohortloom.operators.stats import bh
from cohortloom.session import cut

# Mixing grid, inner folds and path length of the published analysis.
L1_RATIOS = (0.1, 0.3, 0.5, 0.7, 0.9)
INNER = 5
N_ALPHAS = 100
PATH_DEPTH = 1e-3
MAX_SPLITS = 5000


@dataclass(frozen=True)
class Layout:
    """Names of the columns of a row vector, in order. ``group`` is the tested covariate of the
    feature selection; ``adjust`` are the covariates regressed out."""

    covariates: tuple
    features: tuple
    items: tuple
    models: dict
    group: str | None = None
    adjust: tuple = ()

    @property
    def width(self) -> int:
        return len(self.covariates) + len(self.features) + len(self.items)

    def at(self, names) -> list[int]:
        order = {n: i + 1 for i, n in enumerate((*self.covariates, *self.features, *self.items))}
        return [order[n] for n in names]


def repeat_folds(ids: DataFrame, row_id: str, n_rep: int, k: int, seed: int = 42, inner: int = INNER, halves: bool = False, first: int = 0) -> DataFrame:
    """``(row_id, rep, fold, part)``: balanced shuffled folds of every repetition.

    With ``halves`` each repetition first splits the rows in two, and ``rep`` = 2 * repetition + half.
    Repetitions are numbered from ``first``; a number always gives the same folds.
    """
    h = ids.select(row_id, F.explode(F.sequence(F.lit(first), F.lit(first + n_rep - 1))).alias("rep"))
    h = h.withColumn("_h", key_hash(row_id, "rep", seed))
    pos = rank_table(h, ["rep"], "_h").select("rep", "_h", F.col("_below").alias("_p"))
    h = h.join(pos, ["rep", "_h"])
    p, rep = F.col("_p"), F.col("rep")
    if halves:
        rep, p = rep * 2 + (p % 2).cast("int"), F.floor(p / 2)
    return h.select(row_id, rep.alias("rep"), (p % k).cast("int").alias("fold"), (F.floor(p / k) % inner).cast("int").alias("part"))


def fold_table(rows: DataFrame, folds: DataFrame, row_id: str, layout: Layout) -> DataFrame:
    """``(rep, fold, part, g)`` from rows ``(row_id, vec)``."""
    check_width(layout.width)
    return gram_wide(rows.join(folds, row_id), ["rep", "fold", "part"], "vec", layout.width)


def training_parts(cells: DataFrame) -> DataFrame:
    """Training sums of every test fold, still split by part: total of the part minus the fold's own."""
    total = sum_grams(cells, ["rep", "part"]).withColumnRenamed("_gram", "_t")
    # A fold may have no row in a part; its training rows there are all of the part.
    every = cells.select("rep", "fold").distinct().join(total, "rep")
    less = F.when(F.col("_gram").isNull(), F.col("_t")).otherwise(F.zip_with("_t", "_gram", lambda t, g: t - g))
    return every.join(cells, ["rep", "fold", "part"], "left").select("rep", "fold", "part", less.alias("_gram"))


def _select(g: np.ndarray, lay: Layout, alpha: float, tail: str) -> np.ndarray:
    """Features whose group coefficient is significant after Benjamini-Hochberg, per feature set."""
    design = [0, *lay.at([lay.group]), *[i for i in lay.at(lay.covariates) if i not in lay.at([lay.group])]]
    feats = lay.at(lay.features)
    inv = np.linalg.pinv(g[np.ix_(design, design)], hermitian=True)
    xy = g[np.ix_(design, feats)]
    beta = inv @ xy
    dof = g[0, 0] - len(design)
    sse = np.diag(g)[feats] - (beta * xy).sum(0)
    with np.errstate(all="ignore"):
        t = beta[1] / np.sqrt(np.maximum(sse, 1e-300) / dof * inv[1, 1])
    p = t_sf(np.abs(t), dof) * (1 if tail == "one" else 2)
    keep = np.zeros(len(feats), dtype=bool)
    names = np.array(lay.features)
    singles = [m for m in lay.models if not any(set(lay.models[o]) < set(lay.models[m]) for o in lay.models)]
    for m in singles:
        at = np.flatnonzero(np.isin(names, list(lay.models[m])))
        order = at[np.argsort(p[at], kind="stable")]
        adj = np.minimum.accumulate((p[order] * len(order) / np.arange(1, len(order) + 1))[::-1])[::-1]
        keep[order[adj < alpha]] = True
    return keep


def fold_select(parts: DataFrame, layout: Layout, alpha: float = 0.025, tail: str = "one") -> DataFrame:
    """``(rep, fold, selected)``: names of the features selected on the training rows of each fold."""
    train = sum_grams(parts, ["rep", "fold"])
    schema = StructType([StructField("rep", IntegerType()), StructField("fold", IntegerType()), StructField("selected", ArrayType(StringType()))])
    names = np.array(layout.features)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["rep", "fold"]].copy()
        out["selected"] = [names[_select(unpack(g), layout, alpha, tail)].tolist() for g in pdf["_gram"]]
        return out

    return map_rows(train, ["rep", "fold"], step, schema)


def valid_repetitions(selected: DataFrame, layout: Layout, sets, min_features: int, wanted: int) -> DataFrame:
    """First ``wanted`` repetitions of one wave in which every fold selects enough features in every
    set; fewer if the wave has fewer (see ``draw_repetitions``)."""
    counts = [
        F.size(F.array_intersect("selected", F.array(*[F.lit(f) for f in layout.models[s]]))).alias(s) for s in sets
    ]
    ok = selected.select("rep", *counts).groupBy("rep").agg(F.min(F.least(*sets) if len(sets) > 1 else F.col(sets[0])).alias("least"))
    good = ok.filter(F.col("least") >= min_features).select("rep").orderBy("rep").limit(wanted)
    return good


def draw_repetitions(rows: DataFrame, row_id: str, layout: Layout, k: int, sets, min_features: int, wanted: int, alpha: float = 0.025, tail: str = "one", seed: int = 42, most: int = MAX_SPLITS) -> tuple[DataFrame, DataFrame]:
    """Waves of new repetitions until ``wanted`` of them qualify; an error after ``most`` tries.

    Returns the valid repetitions ``(rep)`` and ``(rep, fold, selected)`` of all of them. Each wave is
    as long as what is still missing, at least a tenth of ``wanted``. Only counts reach the driver.
    """
    tried, have, valid, chosen = 0, 0, None, None
    while have < wanted:
        size = min(max(wanted - have, wanted // 10, 1), most - tried)
        if size < 1:
            raise RuntimeError(f"{have} of {wanted} repetitions have {min_features} features in every fold after {tried} tries")
        folds = cut(repeat_folds(rows, row_id, size, k, seed, first=tried))
        selected = cut(fold_select(training_parts(cut(fold_table(rows, folds, row_id, layout))), layout, alpha, tail))
        good = cut(valid_repetitions(selected, layout, sets, min_features, wanted - have))
        kept = selected.join(good, "rep", "left_semi")
        valid = good if valid is None else valid.unionByName(good)
        chosen = kept if chosen is None else chosen.unionByName(kept)
        have += good.count()
        tried += size
    return valid, chosen


def _enet_paths(s, c, alphas, l1, tol=1e-4, sweeps=10000):
    """Coordinate descent for a stack of problems, warm-started along descending penalties.

    ``s`` (m, p, p) and ``c`` (m, p) are cross-products divided by n; ``alphas`` (m, A), ``l1`` (m,).
    Returns (m, A, p).
    """
    m, p = c.shape
    w, r = np.zeros((m, p)), c.copy()
    d = np.einsum("mjj->mj", s)
    ok = d > 1e-12
    out = np.empty((m, alphas.shape[1], p))
    for a in range(alphas.shape[1]):
        thr, ridge = alphas[:, a] * l1, alphas[:, a] * (1 - l1)
        live = np.arange(p)
        for sweep in range(sweeps):
            move = np.zeros(m)
            for j in live:
                old = w[:, j]
                z = r[:, j] + d[:, j] * old
                new = np.where(ok[:, j], np.sign(z) * np.maximum(np.abs(z) - thr, 0) / (d[:, j] + ridge + 1e-300), 0.0)
                step = new - old
                if step.any():
                    r -= s[:, :, j] * step[:, None]
                    w[:, j] = new
                    np.maximum(move, np.abs(step), out=move)
            done = (move <= tol * np.maximum(np.abs(w).max(axis=1), 1e-12)).all()
            if done and len(live) == p:
                break
            # Later sweeps visit the coordinates in use; a full sweep confirms at the end.
            live = np.arange(p) if done or sweep % 10 == 9 else np.flatnonzero((w != 0).any(axis=0))
            if not len(live):
                live = np.arange(p)
        out[:, a] = w
    return out


def enet_fit(parts: list[np.ndarray], lay: Layout, feats: list[int], item: int, l1_ratios=L1_RATIOS, n_alphas=N_ALPHAS):
    """Elastic net on training parts with inner cross-validation over parts.

    Returns linear maps of the augmented raw row: prediction and covariate-adjusted outcome.
    """
    g = sum(parts)
    size = g.shape[0]
    n = g[0, 0]
    given = [0, *lay.at(lay.adjust)]
    rest = [*feats, item]
    coef = np.linalg.pinv(g[np.ix_(given, given)], hermitian=True) @ g[np.ix_(given, rest)]
    maps = np.zeros((len(rest), size))
    maps[np.arange(len(rest)), rest] = 1.0
    maps[:, given] -= coef.T
    var = np.einsum("ij,jk,ik->i", maps, g, maps)[:-1] / n
    sd = np.sqrt(np.maximum(var, 0))
    maps[:-1] *= np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 1e-10)[:, None]
    lift = np.vstack([np.eye(1, size), maps])
    z = [lift @ q @ lift.T for q in parts]
    whole = sum(z)
    p = len(feats)
    xs, ys = slice(1, p + 1), p + 1

    def centre(q):
        k = q[0, 0]
        c = q[1:, 1:] - np.outer(q[0, 1:], q[0, 1:]) / k
        return c[:p, :p] / k, c[:p, -1] / k

    l1 = np.asarray(l1_ratios)
    s_all, c_all = centre(whole)
    top = np.abs(c_all).max() / l1 if p else np.zeros_like(l1)
    grid = np.maximum(top, 1e-12)[:, None] * np.logspace(0, np.log10(PATH_DEPTH), n_alphas)[None, :]
    inner = [q for q in range(len(z)) if z[q][0, 0] > 0]
    ss, cs, meta = [], [], []
    for i in inner:
        s, c = centre(whole - z[i])
        for j in range(len(l1)):
            ss.append(s)
            cs.append(c)
            meta.append((i, j))
    w = _enet_paths(np.array(ss), np.array(cs), np.array([grid[j] for _, j in meta]), np.array([l1[j] for _, j in meta]))
    loss = np.zeros((len(l1), n_alphas))
    for (i, j), path in zip(meta, w, strict=True):
        tr, te = whole - z[i], z[i]
        b0 = (tr[0, ys] - path @ tr[0, xs]) / tr[0, 0]
        u = np.column_stack([-b0, -path, np.ones(n_alphas)])
        loss[j] += np.einsum("ai,ij,aj->a", u, te, u) / te[0, 0]
    j, a = divmod(int(loss.argmin()), n_alphas)
    best = _enet_paths(s_all[None], c_all[None], grid[j][None, : a + 1], l1[j : j + 1])[0, -1]
    b0 = (whole[0, ys] - best @ whole[0, xs]) / whole[0, 0]
    hat = best @ maps[:-1]
    hat[0] += b0
    return hat, maps[-1], float(grid[j, a]), float(l1[j])


def enet_cv(parts: DataFrame, layout: Layout, selected: DataFrame | None = None, l1_ratios=L1_RATIOS, n_alphas: int = N_ALPHAS) -> DataFrame:
    """``(rep, fold, item, model, alpha, l1_ratio, hat, outcome)`` with the two linear maps."""
    work = parts.groupBy("rep", "fold").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "_gram"))), lambda s: s["_gram"]).alias("parts")
    )
    if selected is not None:
        work = work.join(selected, ["rep", "fold"])
    else:
        work = work.withColumn("selected", F.array(*[F.lit(f) for f in layout.features]))
    work = work.withColumn("item", F.explode(F.array(*[F.lit(i) for i in layout.items]))).withColumn(
        "model", F.explode(F.array(*[F.lit(m) for m in layout.models]))
    )
    schema = StructType(
        [
            StructField("rep", IntegerType()),
            StructField("fold", IntegerType()),
            StructField("item", StringType()),
            StructField("model", StringType()),
            StructField("alpha", DoubleType()),
            StructField("l1_ratio", DoubleType()),
            StructField("hat", ArrayType(DoubleType())),
            StructField("outcome", ArrayType(DoubleType())),
        ]
    )

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for rep, fold, packed, chosen, item, model in zip(pdf["rep"], pdf["fold"], pdf["parts"], pdf["selected"], pdf["item"], pdf["model"], strict=True):
            chosen = set(chosen)
            feats = layout.at([f for f in layout.features if f in chosen and f in layout.models[model]])
            ms = [unpack(v) for v in packed]
            hat, outcome, a, l1 = enet_fit(ms, layout, feats, layout.at([item])[0], l1_ratios, n_alphas)
            rows.append((rep, fold, item, model, a, l1, hat, outcome))
        return pd.DataFrame(rows, columns=[f.name for f in schema])

    return map_rows(work, ["rep", "fold", "item", "model"], step, schema)


def outcome_blocks(rows: DataFrame, shuffled: DataFrame, row_id: str, block: int = 64) -> DataFrame:
    """``(row_id, block, perms, ys)``: outcomes of numbered permutations, an array for each row and block of them."""
    at = F.floor(F.col("perm") / block).cast("int").alias("block")
    packed = shuffled.groupBy(row_id, at).agg(F.array_sort(F.collect_list(F.struct("perm", "y"))).alias("_e"))
    return packed.select(row_id, "block", F.transform("_e", lambda e: e["perm"]).alias("perms"), F.transform("_e", lambda e: e["y"]).alias("ys"))


def outcome_sums(rows: DataFrame, folds: DataFrame, outcomes: DataFrame, row_id: str, layout: Layout) -> DataFrame:
    """``(fold, part, block, perms, xy)``: products of ``[1, x]`` with the outcomes of a block, column by column, and
    each outcome's square at the end. Outcomes never meet each other."""
    used = 1 + len(layout.covariates) + len(layout.features)
    x = rows.select(row_id, F.slice("vec", 1, used - 1).alias("x")).join(folds, row_id)
    # Outcomes outgrow every estimate of their size; they are never sent to all tasks.
    joined = outcomes.hint("merge").join(x.hint("merge"), row_id).select("fold", "part", "block", "perms", "x", "ys")
    keys = ["fold", "part", "block"]
    perms = joined.schema["perms"]
    schema = StructType([*[joined.schema[k] for k in keys], perms, StructField("xy", ArrayType(DoubleType()))])

    def partial(batches):
        held: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False):
                x = np.ones((len(part), used))
                x[:, 1:] = np.vstack(part["x"].to_numpy())
                y = np.vstack(part["ys"].to_numpy())
                sums = np.vstack([x.T @ y, (y * y).sum(axis=0)]).ravel()
                held[key] = (part["perms"].iloc[0], held[key][1] + sums if key in held else sums)
        if held:
            out = pd.DataFrame(list(held), columns=keys)
            out["perms"], out["xy"] = [list(v[0]) for v in held.values()], [v[1] for v in held.values()]
            yield out

    parts = joined.mapInPandas(partial, schema)
    named = parts.groupBy("block").agg(F.first("perms").alias("perms"))
    return sum_grams(parts.select(*keys, "xy"), keys, "xy").join(named, "block")


def enet_many(train: list[np.ndarray], xy: list[np.ndarray], lay: Layout, l1_ratios=L1_RATIOS, n_alphas: int = N_ALPHAS):
    """``enet_fit`` for many outcomes at once over one set of features.

    ``train`` are the sums of ``[1, x]`` of each inner part, ``xy`` those with the outcomes (squares in the last row).
    Returns the linear maps of ``[1, x]`` for the predictions and for the covariates' share of the outcomes.
    """
    g, c = sum(train), sum(xy)
    n, size, many = g[0, 0], len(g), c.shape[1]
    given, feats = [0, *lay.at(lay.adjust)], lay.at(lay.features)
    inv = np.linalg.pinv(g[np.ix_(given, given)], hermitian=True)
    share = np.zeros((size, many))
    share[given] = inv @ c[given]
    maps = np.zeros((len(feats), size))
    maps[np.arange(len(feats)), feats] = 1.0
    maps[:, given] -= (inv @ g[np.ix_(given, feats)]).T
    sd = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", maps, g, maps) / n, 0))
    maps *= np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 1e-10)[:, None]
    lift = np.vstack([np.eye(1, size), maps])
    zx = [lift @ q @ lift.T for q in train]
    zy = [lift @ (v[:-1] - q @ share) for q, v in zip(train, xy, strict=True)]
    yy = [v[-1] - 2 * (share * v[:-1]).sum(axis=0) + (share * (q @ share)).sum(axis=0) for q, v in zip(train, xy, strict=True)]
    wx, wy = sum(zx), sum(zy)

    def centre(x, y):
        k, m = x[0, 0], x[0, 1:] / x[0, 0]
        return x[1:, 1:] / k - np.outer(m, m), (y[1:] / k - np.outer(m, y[0] / k)).T

    l1 = np.asarray(l1_ratios)
    s_all, c_all = centre(wx, wy)
    top = np.maximum(np.abs(c_all).max(axis=1)[:, None] / l1, 1e-12)
    grid = top[:, :, None] * np.logspace(0, np.log10(PATH_DEPTH), n_alphas)
    loss = np.zeros((many, len(l1), n_alphas))
    for x, y, square in zip(zx, zy, yy, strict=True):
        k = x[0, 0]
        if k <= 0:
            continue
        s, cs = centre(wx - x, wy - y)
        for j, ratio in enumerate(l1):
            w = _enet_paths(np.broadcast_to(s, (many, *s.shape)), cs, grid[:, j], np.full(many, ratio))
            b0 = ((wy - y)[0][:, None] - w @ (wx - x)[0, 1:]) / (wx - x)[0, 0]
            full = np.concatenate([b0[:, :, None], w], axis=2)
            loss[:, j] += (square[:, None] - 2 * np.einsum("map,pm->ma", full, y) + np.einsum("map,pq,maq->ma", full, x, full)) / k
    pick = loss.reshape(many, -1).argmin(axis=1)
    at = np.arange(many)
    paths = np.empty((many, len(s_all)))
    for j, ratio in enumerate(l1):
        mine = np.flatnonzero(pick // n_alphas == j)
        if len(mine):
            w = _enet_paths(np.broadcast_to(s_all, (len(mine), *s_all.shape)), c_all[mine], grid[mine, j], np.full(len(mine), ratio))
            paths[mine] = w[np.arange(len(mine)), pick[mine] % n_alphas]
    hat = paths @ maps
    hat[at, 0] += (wy[0] - paths @ wx[0, 1:]) / wx[0, 0]
    return hat.T, share


def permuted_scores(cells: DataFrame, sums: DataFrame, layout: Layout, l1_ratios=L1_RATIOS, n_alphas: int = N_ALPHAS) -> DataFrame:
    """``(perm, r)``: pooled held-out correlation of every permuted outcome, from sums only.

    ``cells`` are the sums of the rows by fold and part (one repetition), made once; ``sums`` come from
    ``outcome_sums``. A task fits one fold and one block of outcomes.
    """
    used = 1 + len(layout.covariates) + len(layout.features)
    packed = cells.groupBy().agg(F.collect_list(F.struct("fold", "part", "_gram")).alias("_cells"))  # folds x parts matrices
    mine = sums.groupBy("block").agg(F.first("perms").alias("perms"), F.collect_list(F.struct("fold", "part", "xy")).alias("_xy"))
    fold = cells.select(F.col("fold").alias("test_fold")).distinct()
    work = mine.crossJoin(F.broadcast(fold)).crossJoin(F.broadcast(packed))
    schema = StructType([StructField("perm", IntegerType()), *[StructField(n, DoubleType()) for n in ("n", "sy", "sh", "syy", "shh", "syh")]])

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for test, perms, given, products in zip(pdf["test_fold"], pdf["perms"], pdf["_cells"], pdf["_xy"], strict=True):
            x = {(c["fold"], c["part"]): unpack(c["_gram"])[:used, :used] for c in given}
            y = {(c["fold"], c["part"]): np.reshape(c["xy"], (used + 1, -1)) for c in products}
            parts = sorted({p for _, p in x})
            inner = [[k for k in x if k[1] == p and k[0] != test] for p in parts]
            inner = [ks for ks in inner if ks]
            hat, share = enet_many([sum(x[k] for k in ks) for ks in inner], [sum(y[k] for k in ks) for ks in inner], layout, l1_ratios, n_alphas)
            held = [k for k in x if k[0] == test]
            q, v = sum(x[k] for k in held), sum(y[k] for k in held)
            sy, sh = v[0] - q[0] @ share, q[0] @ hat
            syy = v[-1] - 2 * (share * v[:-1]).sum(axis=0) + (share * (q @ share)).sum(axis=0)
            syh = (hat * (v[:-1] - q @ share)).sum(axis=0)
            values = [np.full(len(perms), q[0, 0]), sy, sh, syy, (hat * (q @ hat)).sum(axis=0), syh]
            out.append(pd.DataFrame({"perm": np.asarray(perms, "int32"), **dict(zip(schema.names[1:], values, strict=True))}))
        return pd.concat(out)

    by_fold = map_rows(work, ["block", "test_fold"], step, schema)
    total = by_fold.groupBy("perm").agg(*[F.sum(c).alias(c) for c in schema.names[1:]])
    norm = (F.col("syy") - F.col("sy") ** 2 / F.col("n")) * (F.col("shh") - F.col("sh") ** 2 / F.col("n"))
    r = F.when(norm > 1e-20, (F.col("syh") - F.col("sy") * F.col("sh") / F.col("n")) / F.sqrt(norm)).otherwise(0.0)
    return total.select("perm", r.alias("r"))


def cv_predictions(rows: DataFrame, folds: DataFrame, fits: DataFrame, row_id: str) -> DataFrame:
    """Held-out predictions ``(row_id, rep, fold, item, model, y, y_hat)``, computed in the JVM."""
    j = rows.join(folds.select(row_id, "rep", "fold"), row_id).join(fits, ["rep", "fold"])
    full = F.concat(F.array(F.lit(1.0)), F.col("vec").cast("array<double>"))
    dot = lambda m: F.aggregate(F.zip_with(full, m, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return j.select(row_id, "rep", "fold", "item", "model", dot("outcome").alias("y"), dot("hat").alias("y_hat"))


def cv_metrics(pred: DataFrame, keys) -> DataFrame:
    """Pearson r (0 if constant), R2 and mean absolute error of pooled predictions per key."""
    y, h = F.col("y"), F.col("y_hat")
    return pred.groupBy(*keys).agg(
        F.count("*").alias("n"),
        corr_or_zero("y", "y_hat").alias("r"),
        (1 - F.try_divide(F.sum((y - h) * (y - h)), F.var_pop(y) * F.count("*"))).alias("r2"),
        F.avg(F.abs(y - h)).alias("mae"),
    )


def item_p(pred: DataFrame, model, item: str) -> DataFrame:
    """Correlation of pooled predictions per model and item, its one-sided p, and p adjusted over the items of a model."""
    model = list(model)
    r = pred.groupBy(*model, item).agg(F.count("*").alias("n"), corr_or_zero("y", "y_hat").alias("r"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    upper = tails.t_tail(F.abs("t"), F.col("n") - 2.0)
    r = r.withColumn("t", t).withColumn("p", F.when(F.col("t") >= 0, upper).otherwise(1 - upper))
    return bh(r, model, "p", "p_adj", small_family=True)  # the items of a questionnaire


def summarise(metrics: DataFrame, keys) -> DataFrame:
    return metrics.groupBy(*keys).agg(
        *[f(c).alias(f"{n}_{c}") for c in ("r", "r2", "mae") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    )
