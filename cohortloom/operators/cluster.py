"""Clustering of profiles and of similarity matrices, and validity indices."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from cohortloom.functions.small import unpack
from cohortloom.operators.gram import check_width, key_fields, map_rows, triangle
from cohortloom.session import cut


def profile_center(df: DataFrame, cols) -> DataFrame:
    """Subtract the row's mean over the profile columns."""
    mean = sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols)
    d = df.withColumn("_m", mean)
    return d.withColumns({c: F.col(c) - F.col("_m") for c in cols}).drop("_m")


def outlier_flags(df: DataFrame, cols, threshold: float) -> DataFrame:
    return df.withColumns({c: (F.abs(c) > threshold).cast("int") for c in cols})


MODEL_ROWS = 16384  # rows that are worth a task of k-means


class Models:
    """Centroids of many k-means models: for each k an array (start, cluster, column)."""

    def __init__(self, ks, restarts: int, width: int):
        self.ks, self.restarts = tuple(ks), restarts
        self.centres = {k: np.zeros((restarts, k, width)) for k in self.ks}

    def nearest(self, x: np.ndarray, k: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest cluster of every row in every live start, and the squared distance."""
        c = self.centres[k][live]
        flat = c.reshape(-1, x.shape[1])
        d = (flat * flat).sum(axis=1) - 2 * x @ flat.T
        d = d.reshape(len(x), -1, k)
        at = d.argmin(axis=2)
        return at, np.maximum(np.take_along_axis(d, at[:, :, None], axis=2)[:, :, 0] + (x * x).sum(axis=1)[:, None], 0)


def _model_seeds(data: DataFrame, row_id: str, ks, restarts: int, seed: int, width: int) -> Models:
    """Distinct rows of lowest hash as the first centroids of every model; a task keeps the k lowest of each."""
    tops = [(k, r) for k in ks for r in range(restarts)]
    schema = StructType([StructField("m", IntegerType()), StructField("h", LongType()), StructField("v", ArrayType(DoubleType()))])

    def lowest(batches):
        best: dict = {}
        for pdf in batches:
            h = pdf["h"].to_numpy().astype(np.uint64)
            v = pdf["v"].to_numpy()
            for m, (k, r) in enumerate(tops):
                with np.errstate(over="ignore"):
                    z = (h ^ np.uint64((seed + 1) * 1000003 + k * 7919 + r)) * np.uint64(0x9E3779B97F4A7C15)
                    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    z = ((z ^ (z >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)
                at = np.argsort(z, kind="stable")[:k] if len(z) <= k else np.argpartition(z, k - 1)[:k]
                best[m] = sorted([*best.get(m, []), *((int(z[i]), tuple(v[i])) for i in at)])[:k]
        rows = [(m, z, list(v)) for m, found in best.items() for z, v in found]
        if rows:
            yield pd.DataFrame(rows, columns=["m", "h", "v"])

    found = data.select(F.xxhash64(row_id).alias("h"), "v").mapInPandas(lowest, schema)
    ranked = found.withColumn("p", F.row_number().over(Window.partitionBy("m").orderBy("h", "v")))
    models = Models(ks, restarts, width)
    k_of = F.element_at(F.array(*[F.lit(k) for k, _ in tops]), F.col("m") + 1)
    for row in ranked.filter(F.col("p") <= k_of).collect():  # one row for each centroid
        k, r = tops[row.m]
        models.centres[k][r, row.p - 1 :] = row.v
    return models


def kmeans_scan(df: DataFrame, row_id: str, cols, ks=(2, 3, 4, 5), restarts: int = 50, seed: int = 42, most: int = 300, tol: float = 1e-4):
    """K-means for several k, best of ``restarts`` by cost; all models move in the same jobs.

    The centroids of all (k, start) are one small table. A job assigns every row under all models that still move and
    returns their sums, so its number does not depend on how many models there are. Rows with a null are left out.
    Returns (labels ``(k, row_id, cluster)``, inertia ``(k, inertia)``). Clusters are numbered by
    their sorted centroids, so the labels do not depend on the start.
    """
    spark = df.sparkSession
    width = len(cols)
    data = df.dropna(subset=list(cols)).select(row_id, F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))
    # A small file is read by few tasks, but each of its rows meets every centroid in every job.
    data = data.repartition(max(1, min(spark.sparkContext.defaultParallelism, data.count() // MODEL_ROWS)), row_id).persist()
    models = _model_seeds(data, row_id, ks, restarts, seed, width)
    moving = {k: np.ones(restarts, bool) for k in models.ks}
    schema = StructType([StructField("k", IntegerType()), StructField("start", IntegerType()), StructField("c", IntegerType()), StructField("s", ArrayType(DoubleType()))])

    def assign(moving: dict) -> dict:
        """(k, start, cluster): sums of the columns, number of rows, squared distances."""
        shared = spark.sparkContext.broadcast((models, moving))

        def sums(batches):
            now, live = shared.value
            total = {k: np.zeros((on.sum(), k, width + 2)) for k, on in live.items() if on.any()}
            for pdf in batches:
                if len(pdf):
                    x = np.vstack(pdf["v"].to_numpy())
                    full = np.column_stack([x, np.ones(len(x))])
                    for k in total:
                        at, d = now.nearest(x, k, live[k])
                        for c in range(k):
                            inside = at == c
                            total[k][:, c, : width + 1] += inside.T @ full
                            total[k][:, c, -1] += (inside * d).sum(axis=0)
            rows = [(k, int(r), c, t[i, c].tolist()) for k, t in total.items() for i, r in enumerate(np.flatnonzero(live[k])) for c in range(k)]
            yield pd.DataFrame(rows, columns=["k", "start", "c", "s"])

        parts = data.select("v").mapInPandas(sums, schema)
        added = parts.groupBy("k", "start", "c").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(width + 2)]).alias("s"))
        out = {(r.k, r.start, r.c): np.array(r.s) for r in added.collect()}  # one row for each centroid
        shared.unpersist()
        return out

    for _ in range(most):
        if not any(on.any() for on in moving.values()):
            break
        shift = {k: np.zeros(restarts) for k in models.ks}
        for (k, r, c), s in assign(moving).items():
            if s[width] > 0:
                new = s[:width] / s[width]
                shift[k][r] = max(shift[k][r], np.sqrt(((new - models.centres[k][r, c]) ** 2).sum()))
                models.centres[k][r, c] = new
        moving = {k: on & (shift[k] > tol) for k, on in moving.items()}
    cost = {k: np.zeros(restarts) for k in models.ks}
    for (k, r, _), s in assign({k: np.ones(restarts, bool) for k in models.ks}).items():
        cost[k][r] += s[-1]
    best = Models(models.ks, 1, width)
    for k in models.ks:
        centres = models.centres[k][int(cost[k].argmin())]
        best.centres[k][0] = centres[sorted(range(k), key=lambda c: tuple(centres[c]))]
    one = np.ones(1, bool)
    labelled = StructType([StructField("k", IntegerType()), df.schema[row_id], StructField("cluster", IntegerType())])

    def label(batches):
        for pdf in batches:
            if len(pdf):
                x = np.vstack(pdf["v"].to_numpy())
                for k in best.ks:
                    yield pd.DataFrame({"k": np.int32(k), row_id: pdf[row_id], "cluster": best.nearest(x, k, one)[0][:, 0].astype("int32")})

    labels = cut(data.mapInPandas(label, labelled))
    data.unpersist()
    return labels, spark.createDataFrame([(k, float(cost[k].min())) for k in models.ks], "k int, inertia double")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


SIDE = 16  # blocks of rows at least, as far as these are worth it
BLOCK_CELLS = 4 << 20  # numbers in a block of vectors at most
TILE = 256  # rows of a block whose distances to the other block exist at a time


def _pair_rows(blocks: int) -> Column:
    """The block pairs (i, j), i <= j, that a row of block ``_b`` takes part in, as (i, j)."""
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    return F.explode(F.transform(others, lambda o: F.struct(F.least("_b", o).alias("i"), F.greatest("_b", o).alias("j"))))


def _matrix(column, width: int | None = None) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, width or 1))


def _pair_sums(a: np.ndarray, b: np.ndarray, ha: np.ndarray, hb: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the distances of every row to the clusters of the other side, for both sides; ``hb`` None: within ``a``."""
    same = hb is None
    b, hb = (a, ha) if same else (b, hb)
    to_b, to_a = np.zeros((len(a), hb.shape[1])), np.zeros((len(b), ha.shape[1]))
    right = np.column_stack([b, np.ones(len(b)), (b * b).sum(axis=1)]).T.copy()
    for lo in range(0, len(a), TILE):
        x = a[lo : lo + TILE]
        left = np.column_stack([-2 * x, (x * x).sum(axis=1), np.ones(len(x))])
        for at in range(0, len(b), TILE):
            d = left @ right[:, at : at + TILE]
            # Squares through the dot product leave rounding noise where rows are equal.
            d[d < 1e-14] = 0.0
            np.sqrt(d, out=d)
            if same and at == lo:
                np.fill_diagonal(d, 0.0)
            to_b[lo : lo + TILE] += d @ hb[at : at + TILE]
            if not same:
                to_a[at : at + TILE] += d.T @ ha[lo : lo + TILE]
    return to_b, to_a


def silhouettes(df: DataFrame, row_id: str, vec: str, labels: dict[str, Column], block_rows: int | None = None) -> DataFrame:
    """Exact silhouettes with Euclidean distance of several labellings: ``(name, row_id, label, silhouette)``.

    The metric needs every distance; each is made once, for both of its rows and all labellings. A task holds one pair
    of blocks of rows and returns, per row, the distance sums to each cluster - never the distances. The number of
    blocks is fixed until a block would outgrow a task, so the rows that travel grow with the input. ``labels`` are
    columns of ``df`` of one type.
    """
    names = list(labels)
    one = F.array(*[F.struct(F.lit(i).alias("m"), c.alias("c")) for i, c in enumerate(labels.values())])
    base = df.select(row_id, F.col(vec).cast("array<double>").alias("v"), one.alias("l"))
    n, width = base.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = -(-n // block_rows) if block_rows else max(min(SIDE, -(-n // TILE)), -(-n * ((width or 0) + 16) // BLOCK_CELLS))
    base = base.withColumn("_b", F.pmod(F.xxhash64(row_id), F.lit(max(1, blocks))).cast("int"))
    rows = base.select(row_id, "v", "l", "_b", _pair_rows(max(1, blocks)).alias("_p")).select("_p.i", "_p.j", "_b", row_id, "v", "l")
    kind = base.schema["l"].dataType.elementType["c"].dataType
    schema = StructType([df.schema[row_id], StructField("m", IntegerType()), StructField("other", kind), StructField("s", DoubleType())])
    target = to_arrow_schema(schema)

    def sums(table: pa.Table) -> pa.Table:
        first = np.asarray(table.column("_b")) == np.asarray(table.column("i"))
        same = bool(first.all()) and table.column("i")[0] == table.column("j")[0]
        sides = [table.filter(pa.array(first)), table.filter(pa.array(~first))]
        x = [_matrix(t.column("v")) for t in sides]
        found = []
        for t in sides:
            flat = t.column("l").combine_chunks().flatten()
            m, c = flat.field("m").to_numpy(zero_copy_only=False), flat.field("c").dictionary_encode()
            code, size = c.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(c.dictionary))
            known = code >= 0  # rows without a label count for none
            pair, at = np.unique(m[known] * size + code[known], return_inverse=True)
            member = np.zeros((len(t), len(pair)))
            member[np.repeat(np.arange(len(t)), len(names))[known], at] = 1.0
            found.append(((pair // size).astype(np.int32), c.dictionary.take(pa.array(pair % size)), member))
        if same:
            parts = [(sides[0], found[0], _pair_sums(x[0], x[0], found[0][2], None)[0])]
        elif len(x[0]) and len(x[1]):
            to_b, to_a = _pair_sums(x[0], x[1], found[0][2], found[1][2])
            parts = [(sides[0], found[1], to_b), (sides[1], found[0], to_a)]
        else:
            parts = []
        out = []
        for t, (m, c, _), s in parts:
            row, column = np.repeat(np.arange(s.shape[0]), s.shape[1]), np.tile(np.arange(s.shape[1]), s.shape[0])
            out.append(pa.Table.from_arrays([t.column(row_id).take(pa.array(row)), pa.array(m[column]), c.take(pa.array(column)), pa.array(s.ravel())], schema=target))
        return pa.concat_tables(out) if out else target.empty_table()

    total = rows.groupBy("i", "j").applyInArrow(sums, schema).groupBy(row_id, "m", "other").agg(F.sum("s").alias("s"))
    own = base.select(row_id, F.explode("l").alias("l")).select(row_id, "l.m", "l.c")
    sizes = own.groupBy("m", F.col("c").alias("other")).agg(F.count("*").alias("size"))
    j = total.join(sizes, ["m", "other"]).join(own, [row_id, "m"])
    mine = F.col("other") == F.col("c")
    g = j.groupBy(row_id, "m", "c").agg(
        F.max(F.when(mine, F.col("size"))).alias("size"),
        F.max(F.when(mine & (F.col("size") > 1), F.col("s") / (F.col("size") - 1))).alias("a"),
        F.min(F.when(~mine, F.col("s") / F.col("size"))).alias("b"),
    )
    big = F.greatest("a", "b")
    value = F.when((F.col("size") > 1) & (big > 0), (F.col("b") - F.col("a")) / big).otherwise(0.0)
    name = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("m") + 1)
    return g.select(name.alias("name"), row_id, F.col("c").alias("label"), value.alias("silhouette"))


def silhouette(df: DataFrame, row_id: str, vec: str, label: str, block_rows: int | None = None) -> DataFrame:
    """Exact silhouette with Euclidean distance, per row."""
    one = silhouettes(df, row_id, vec, {label: F.col(label)}, block_rows)
    return one.select(row_id, F.col("label").alias(label), "silhouette")


def cluster_validity(df: DataFrame, vec: str, label: str, width: int) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin indices from cluster sums."""
    check_width(width)
    v = F.col(vec).cast("array<double>")
    sq = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    norms = df.groupBy(label).agg(F.count("*").alias("n"), F.sum(sq).alias("ss"))
    means = df.select(label, F.posexplode(v).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    centre = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    # Mean distance to the own centre, for Davies-Bouldin.
    off = F.sqrt(F.aggregate(F.zip_with(v, "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    spread = df.join(centre, label).groupBy(label).agg(F.avg(off).alias("spread"))
    rows = norms.join(centre, label).join(spread, label)
    one = rows.groupBy().agg(F.collect_list(F.struct("n", "ss", "c", "spread")).alias("_all"))
    schema = StructType(
        [StructField("k", IntegerType()), StructField("calinski_harabasz", DoubleType()), StructField("davies_bouldin", DoubleType())]
    )

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        # One row per cluster, whatever the number of data rows.
        cl = pdf["_all"].iloc[0]
        n = np.array([c["n"] for c in cl], dtype=float)
        c = np.array([list(x["c"]) for x in cl])
        ss, sp = np.array([x["ss"] for x in cl]), np.array([x["spread"] for x in cl])
        k, total = len(n), n.sum()
        grand = (n[:, None] * c).sum(0) / total
        between = (n * ((c - grand) ** 2).sum(1)).sum()
        within = (ss - n * (c * c).sum(1)).sum()
        d = _squares(c, c)
        np.fill_diagonal(d, np.inf)
        db = ((sp[:, None] + sp[None, :]) / d).max(axis=1).mean()
        return pd.DataFrame({"k": [np.int32(k)], "calinski_harabasz": [between / (k - 1) / (within / (total - k))], "davies_bouldin": [db]})

    return map_rows(one, [], step, schema, spread=False)


def knee(df: DataFrame, k: str, value: str) -> DataFrame:
    """k whose inertia lies farthest below the chord from the first to the last k."""
    w = Window.partitionBy(F.lit(0)).orderBy(k).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.select(
        k, value, F.first(k).over(w).alias("_k0"), F.last(k).over(w).alias("_k1"), F.first(value).over(w).alias("_v0"), F.last(value).over(w).alias("_v1")
    )
    chord = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.try_divide(F.col(k) - F.col("_k0"), F.col("_k1") - F.col("_k0"))
    return d.groupBy().agg(F.max_by(k, F.struct(chord - F.col(value), -F.col(k))).alias("knee"))


def consensus_k(votes: DataFrame, k: str, min_k: int) -> DataFrame:
    """Rounded mean of the indices' choices, at least ``min_k``."""
    return votes.agg(F.greatest(F.lit(min_k), F.bround(F.avg(k)).cast("int")).alias("k"))


def _merges(d: np.ndarray) -> np.ndarray:
    """Minimum-variance merges of a distance matrix in order: (a, b, height, size).

    Leaves are 0 to n - 1, merge i makes node n + i. The nearest neighbour of every cluster is kept, so a merge reads
    one row and not the matrix.
    """
    n = len(d)
    d = d.astype(float) ** 2
    np.fill_diagonal(d, np.inf)
    size, live, node = np.ones(n), np.ones(n, dtype=bool), np.arange(n)
    near = d.argmin(axis=1)
    least = d[np.arange(n), near]
    out = np.zeros((n - 1, 4))
    for step in range(n - 1):
        i = int(least.argmin())
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        out[step] = (*sorted((node[i], node[j])), np.sqrt(d[i, j]), size[i] + size[j])
        row = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        live[j] = False
        row[~live] = np.inf
        row[i] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j], least[j] = np.inf, np.inf, np.inf
        size[i] += size[j]
        node[i] = n + step
        again = np.flatnonzero(live & ((near == i) | (near == j)))
        again = np.union1d(again, [i])
        near[again] = d[again].argmin(axis=1)
        least[again] = d[again, near[again]]
        closer = live & (row < least)
        near[closer], least[closer] = i, row[closer]
    return out


def _cut_tree(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels of k clusters, numbered by their first member."""
    parent = np.arange(2 * n - 1)
    for step, (a, b, *_) in enumerate(merges[: n - k]):
        parent[int(a)] = parent[int(b)] = n + step
    top = np.arange(n)
    while (parent[top] != top).any():
        top = parent[top]
    order: dict = {}
    return np.array([order.setdefault(t, len(order)) for t in top.tolist()])


def _distances(v, distance: bool) -> np.ndarray:
    """Distances ``1 - minmax`` of packed similarities, unless they are distances already."""
    s = unpack(v)
    if not distance:
        lo, hi = s.min(), s.max()
        s = 1 - (s - lo) / (hi - lo) if hi > lo else 1 - s
        np.fill_diagonal(s, 0)
    return s


def ward_tree(sims: DataFrame, keys, width: int, distance: bool = False) -> DataFrame:
    """The dendrogram of each key's packed matrix, made once: ``(keys, step, a, b, height, size)``."""
    check_width(width)
    fields = [StructField(c, IntegerType()) for c in ("step", "a", "b")] + [StructField("height", DoubleType()), StructField("size", IntegerType())]
    schema = StructType([*key_fields(sims, keys), *fields])

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        trees = [_merges(_distances(v, distance)) for v in pdf["sim"]]
        out = pdf[list(keys)].iloc[np.repeat(np.arange(len(pdf)), width - 1)].reset_index(drop=True)
        out["step"] = np.tile(np.arange(width - 1), len(pdf)).astype("int32")
        all_ = np.vstack(trees) if trees else np.zeros((0, 4))
        for i, c in enumerate(("a", "b", "height", "size")):
            out[c] = all_[:, i] if c == "height" else all_[:, i].astype("int32")
        return out

    return map_rows(sims, keys, step, schema)


def ward_scan(tree: DataFrame, keys, width: int, ks, number: str = "k") -> DataFrame:
    """Labels ``(keys, k, f, cluster)`` of every k from the stored merges; ``number`` names the column of k."""
    packed = tree.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", "a", "b"))).alias("_m"))
    schema = StructType([*key_fields(tree, keys), *[StructField(c, IntegerType()) for c in (number, "f", "cluster")]])
    ks = tuple(ks)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for i, m in enumerate(pdf["_m"]):
            merges = np.array([(r["a"], r["b"]) for r in m])
            for k in ks:
                out = pdf[list(keys)].iloc[np.full(width, i)].reset_index(drop=True)
                out[number], out["f"], out["cluster"] = np.int32(k), np.arange(width, dtype="int32"), _cut_tree(merges, width, k).astype("int32")
                parts.append(out)
        return pd.concat(parts)

    return map_rows(packed, keys, step, schema)


def ward(sims: DataFrame, keys, width: int, k: int, distance: bool = False) -> DataFrame:
    """Ward clusters of the features of each key's packed similarity matrix: ``(keys, f, cluster)``.

    Similarities become distances ``1 - minmax`` first, unless they are distances already.
    """
    return ward_scan(ward_tree(sims, keys, width, distance), keys, width, [k], "_k").drop("_k")


def distance_cells(sims: DataFrame, keys, width: int, distance: bool = False) -> DataFrame:
    """Stored distances in long form, both ways: ``(keys, f1, f2, d)`` without the diagonal."""
    i, j = triangle("_p", width)
    cells = sims.select(*keys, F.posexplode("sim").alias("_p", "s"), *([] if distance else [F.array_min("sim").alias("_lo"), F.array_max("sim").alias("_hi")]))
    d = F.col("s") if distance else F.when(F.col("_hi") > F.col("_lo"), 1 - (F.col("s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1 - F.col("s"))
    upper = cells.select(*keys, i.alias("f1"), j.alias("f2"), d.alias("d")).filter("f1 <> f2")
    return upper.unionByName(upper.select(*keys, F.col("f2").alias("f1"), F.col("f1").alias("f2"), "d"))


def stored_silhouette(distances: DataFrame, labels: DataFrame, keys) -> DataFrame:
    """Silhouette ``(keys, k, f, cluster, silhouette)`` of every k from stored distances."""
    keys = list(keys)
    one = labels.select(*keys, "k", F.col("f").alias("f1"), F.col("cluster").alias("c1"))
    two = labels.select(*keys, "k", F.col("f").alias("f2"), F.col("cluster").alias("c2"))
    sums = distances.join(two, [*keys, "f2"]).groupBy(*keys, "k", "f1", "c2").agg(F.sum("d").alias("s"), F.count("*").alias("m"))
    mean = F.col("s") / F.col("m")
    own = F.col("c1") == F.col("c2")
    each = sums.join(one, [*keys, "k", "f1"]).groupBy(*keys, "k", "f1", "c1").agg(F.max(F.when(own, mean)).alias("a"), F.min(F.when(~own, mean)).alias("b"))
    big = F.greatest("a", "b")
    value = F.when(F.col("a").isNotNull() & (big > 0), (F.col("b") - F.col("a")) / big).otherwise(0.0)
    return each.select(*keys, "k", F.col("f1").alias("f"), F.col("c1").alias("cluster"), value.alias("silhouette"))


def cluster_members(labels: DataFrame, keys, member: str, cluster: str) -> DataFrame:
    """Members per cluster in order; a cluster of features is bounded by the vocabulary."""
    return labels.groupBy(*keys, cluster).agg(F.array_sort(F.collect_list(member)).alias("members"), F.count("*").alias("n"))


