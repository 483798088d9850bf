"""Path models of observed variables, from grouped covariances."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from cohortloom.functions import tails
from cohortloom.functions.small import centred, condition_on, unpack
from cohortloom.operators.gram import key_fields, map_rows, moments
from cohortloom.operators.temporal import join_stats


@dataclass(frozen=True)
class Structure:
    """Recursive path model: ``equations`` maps an outcome to its predictors, causes first."""

    name: str
    equations: tuple

    @property
    def outcomes(self) -> list[str]:
        return [o for o, _ in self.equations]

    @property
    def exogenous(self) -> list[str]:
        seen: list[str] = []
        for _, preds in self.equations:
            seen += [p for p in preds if p not in self.outcomes and p not in seen]
        return seen

    @property
    def variables(self) -> list[str]:
        return [*self.exogenous, *self.outcomes]


# The four competing structures (salience, control and default networks, two behaviours).
STRUCTURES = (
    Structure("model1", (("cen", ("sal",)), ("dmn", ("sal", "cen")), ("cog", ("dmn",)), ("srs", ("dmn",)))),
    Structure("model2", (("cen", ("sal",)), ("dmn", ("sal", "cen")), ("cog", ("cen",)), ("srs", ("dmn",)))),
    Structure("model3", (("dmn", ("sal",)), ("cen", ("sal", "dmn")), ("cog", ("cen",)), ("srs", ("cen",)))),
    Structure("model4", (("cen", ("sal",)), ("dmn", ("sal",)), ("cog", ("dmn",)), ("srs", ("dmn",)))),
)
VARIABLES = ("sal", "cen", "dmn", "cog", "srs")


def covariance(df: DataFrame, keys, cols) -> DataFrame:
    """Cross-products around the mean, per key, of complete rows; the input of every fit."""
    return moments(df.dropna(subset=list(cols)), keys, cols)


def _equations(s: np.ndarray, st: Structure, cols) -> list:
    at = {c: i for i, c in enumerate(cols)}
    out = []
    for o, preds in st.equations:
        x, y = [at[p] for p in preds], at[o]
        inv = np.linalg.pinv(s[np.ix_(x, x)], hermitian=True)
        b = inv @ s[x, y]
        out.append((y, x, b, s[y, y] - b @ s[x, y], inv))
    return out


def _fit_indices(n: float, s: np.ndarray, st: Structure, cols) -> dict:
    v = [list(cols).index(c) for c in st.variables]
    s = s[np.ix_(v, v)]
    names, p, q = st.variables, len(v), len(st.exogenous)
    eqs = _equations(s, st, names)
    b, psi = np.zeros((p, p)), np.zeros((p, p))
    psi[:q, :q] = s[:q, :q]
    for y, x, coef, res, _ in eqs:
        b[y, x] = coef
        psi[y, y] = res
    inv = np.linalg.inv(np.eye(p) - b)
    sigma = inv @ psi @ inv.T
    log = lambda m: np.linalg.slogdet(m)[1]
    trace = np.trace(s @ np.linalg.inv(sigma))
    chi = max(n * (log(sigma) + trace - log(s) - p), 0.0)
    n_par = sum(len(x) for _, x, *_ in eqs) + len(eqs)
    df = p * (p + 1) // 2 - n_par - q * (q + 1) // 2
    base = n * (np.log(np.diag(s)[q:]).sum() + log(s[:q, :q]) - log(s))
    df0 = p * (p - 1) // 2 - q * (q - 1) // 2
    minus2l = n * ((p - q) * np.log(2 * np.pi) + log(sigma) - log(s[:q, :q]) + trace - q)
    over, over0 = max(chi - df, 0.0), max(base - df0, chi - df, 0.0)
    sd = np.sqrt(np.diag(s))
    r = ((s - sigma) / np.outer(sd, sd))[np.tril_indices(p)]
    return {
        "chi2": chi, "df": df, "aic": minus2l + 2 * n_par, "bic": minus2l + n_par * np.log(n),
        "cfi": 1 - over / over0 if over0 > 0 else 1.0,
        "tli": (base / df0 - chi / df) / (base / df0 - 1) if df > 0 and base / df0 != 1 else 1.0,
        "rmsea": np.sqrt(over / (n * df)) if df > 0 else 0.0, "srmr": np.sqrt((r**2).mean()),
    }


_INDEX = ("chi2", "aic", "bic", "cfi", "tli", "rmsea", "srmr")


def path_fit(cov: DataFrame, keys, cols, structures=STRUCTURES) -> DataFrame:
    """Fit indices of every structure per key."""
    schema = StructType(
        [*key_fields(cov, keys), StructField("model", StringType()), StructField("n", LongType()), StructField("df", LongType()),
         *[StructField(c, DoubleType()) for c in _INDEX]]
    )

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        n, _, s = centred(unpack(np.vstack(pdf["_gram"].to_numpy())))
        for st in structures:
            fits = pd.DataFrame([_fit_indices(n[i], s[i] / n[i], st, cols) for i in range(len(pdf))])
            part = pdf[list(keys)].reset_index(drop=True)
            part["model"], part["n"] = st.name, n.astype("int64")
            part["df"] = fits["df"].astype("int64")
            for c in _INDEX:
                part[c] = fits[c].astype(float)
            parts.append(part)
        return pd.concat(parts, ignore_index=True)

    out = map_rows(cov, keys, step, schema)
    return out.withColumn("p", F.when(F.col("df") > 0, tails.chi2_tail("chi2", F.col("df").cast("double"))))


def path_coefficients(cov: DataFrame, keys, cols, structures=STRUCTURES) -> DataFrame:
    """Every path: estimate, standard error, z, standardised estimate."""
    fields = ("est", "se", "std_all")
    schema = StructType(
        [*key_fields(cov, keys), StructField("model", StringType()), StructField("outcome", StringType()), StructField("predictor", StringType()),
         *[StructField(c, DoubleType()) for c in fields]]
    )

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        n, _, s = centred(unpack(np.vstack(pdf["_gram"].to_numpy())))
        ids = list(pdf[list(keys)].itertuples(index=False, name=None)) if keys else [()] * len(pdf)
        for i, key in enumerate(ids):
            c = s[i] / n[i]
            for st in structures:
                for y, x, b, res, inv in _equations(c, st, cols):
                    for a, xa in enumerate(x):
                        rows.append((*key, st.name, cols[y], cols[xa], b[a], np.sqrt(max(res, 0) * inv[a, a] / n[i]), b[a] * np.sqrt(c[xa, xa] / c[y, y])))
        return pd.DataFrame(rows, columns=[f.name for f in schema])

    out = map_rows(cov, keys, step, schema)
    z = F.when(F.col("se") > 0, F.col("est") / F.col("se"))
    out = out.withColumn("z", z)
    return out.withColumn("p", F.when(F.col("z").isNotNull(), 2 * tails.z_tail(F.abs("z"))))


def indirect_effects(coefs: DataFrame, keys, model: str = "model1") -> DataFrame:
    """Indirect, total and cascade effects of the mediation model with delta-method errors.

    Coefficients of different equations are independent. Inside the default-network equation the
    covariance of b and c is ``-a var(b)``, because a is the slope of cen on sal.
    """
    p = lambda o, x, c: F.max(F.when((F.col("outcome") == o) & (F.col("predictor") == x), F.col(c)))
    g = coefs.filter(F.col("model") == model).groupBy(*keys).agg(
        *[
            p(o, x, c).alias(f"{n}_{c}")
            for n, o, x in (("a", "cen", "sal"), ("b", "dmn", "cen"), ("c", "dmn", "sal"), ("d", "srs", "dmn"), ("e", "cog", "dmn"))
            for c in ("est", "se")
        ]
    )
    e = lambda n: F.col(f"{n}_est")
    v = lambda n: F.col(f"{n}_se") * F.col(f"{n}_se")
    ab = e("b") * e("b") * v("a") + e("a") * e("a") * v("b")
    total = v("c") + ab - 2 * e("a") * e("a") * v("b")
    cascade = lambda n: e(n) * e(n) * ab + e("a") * e("a") * e("b") * e("b") * v(n)
    rows = F.array(
        F.struct(F.lit("ind_sal_dmn").alias("effect"), (e("a") * e("b")).alias("est"), F.sqrt(ab).alias("se")),
        F.struct(F.lit("total_sal_dmn").alias("effect"), (e("c") + e("a") * e("b")).alias("est"), F.sqrt(F.greatest(total, F.lit(0.0))).alias("se")),
        F.struct(F.lit("cascade_sal_srs").alias("effect"), (e("a") * e("b") * e("d")).alias("est"), F.sqrt(cascade("d")).alias("se")),
        F.struct(F.lit("cascade_sal_cog").alias("effect"), (e("a") * e("b") * e("e")).alias("est"), F.sqrt(cascade("e")).alias("se")),
    )
    out = g.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")
    return out.withColumn("z", F.when(F.col("se") > 0, F.col("est") / F.col("se")))


def path_table(fits: DataFrame, coefs: DataFrame, keys, model: str = "model1") -> DataFrame:
    """Headline row per key: fit indices and raw and standardised paths."""
    named = coefs.filter(F.col("model") == model).withColumn("_n", F.concat_ws("_to_", "predictor", "outcome"))
    pairs = [("sal", "cen"), ("cen", "dmn"), ("sal", "dmn"), ("dmn", "srs"), ("dmn", "cog")]
    wide = named.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_n") == f"{x}_to_{y}", F.col(c))).alias(f"{x}_to_{y}_{t}") for x, y in pairs for c, t in (("est", "beta"), ("std_all", "std"), ("z", "z"))]
    )
    f = fits.filter(F.col("model") == model).select(*keys, "n", "chi2", "df", "cfi", "tli", "rmsea", "srmr")
    return join_stats(f, wide, keys)


def group_invariance(cov: DataFrame, group: str, cols, structure: Structure, family=()) -> DataFrame:
    """Equal path coefficients across groups against free ones: chi-square difference.

    Intercepts and residual variances stay free in every group.
    """
    family = list(family)
    schema = StructType(
        [*key_fields(cov, family), StructField("n_groups", LongType()), StructField("chi2_diff", DoubleType()), StructField("df_diff", LongType()), StructField("converged", BooleanType())]
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, _, s = centred(unpack(np.vstack(pdf["_gram"].to_numpy())))
        at = {c: i for i, c in enumerate(cols)}
        chi, n_par, settled = 0.0, 0, True
        for o, preds in structure.equations:
            x, y = [at[p] for p in preds], at[o]
            xx, xy, yy = s[:, x][:, :, x], s[:, x, y], s[:, y, y]
            free = np.array([condition_on(s[i], x, [y])[0, 0] for i in range(len(n))]) / n
            var, b = free.copy(), None
            for _ in range(500):
                new = np.linalg.solve((xx / var[:, None, None]).sum(0), (xy / var[:, None]).sum(0))
                var = (yy - 2 * xy @ new + np.einsum("i,gij,j->g", new, xx, new)) / n
                done = b is not None and np.abs(new - b).max() < 1e-12
                b = new
                if done:
                    break
            settled &= done
            chi += float((n * np.log(var / free)).sum())
            n_par += len(x)
        out = pdf[family].iloc[:1].reset_index(drop=True) if family else pd.DataFrame(index=range(1))
        return out.assign(n_groups=len(n), chi2_diff=chi, df_diff=(len(n) - 1) * n_par, converged=bool(settled))

    rows = cov if family else cov.withColumn("_one", F.lit(0))
    out = rows.groupBy(*(family or ["_one"])).applyInPandas(solve, schema)  # one row per compared group
    return out.withColumn("p", tails.chi2_tail("chi2_diff", F.col("df_diff").cast("double")))
