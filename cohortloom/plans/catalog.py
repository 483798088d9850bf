"""Registry of queries: name, inventory ids, Spark plan, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.sources.tables import read_table, to_long

WIDTH = 64  # length of the vectors in `embeddings`, part of its schema


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(ids.split()), fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def rd(c, n: int = 6) -> Column:
    """Rounded for comparison with another engine, without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, n) + F.lit(0.0)


def rounded(df: DataFrame, n: int = 6, /, **digits: int) -> DataFrame:
    """Round every floating column; ``digits`` overrides single columns."""
    out = []
    for f in df.schema:
        if f.dataType.typeName() in ("double", "float"):
            out.append(rd(f.name, digits.get(f.name, n)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def R(expr: str, n: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {n}) + 0.0"


def emb_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(table(spark, sf_dir, "embeddings"), ["vec_id", "label"], "embedding")


EMB = (
    "emb AS (SELECT vec_id, label, CAST(unnest(range(0, 64)) AS INTEGER) AS parcel, "
    "CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
)
LINE_Q = "li AS (SELECT *, l_quantity AS q, l_extendedprice AS x, l_discount AS d, l_tax AS w FROM lineitem)"


# SQL text for tail probabilities, by Simpson's rule; independent of the library's own formulas.
def beta_tail_sql(theta0: str, d1: str, d2: str, n: int = 600) -> str:
    """Upper tail of F(d1, d2), where sin^2(theta0) = d1 F / (d1 F + d2)."""
    width = f"least(pi()/2 - ({theta0}), 14.0/sqrt(({d2})))"
    i = "CAST(i AS DOUBLE)"
    at = f"(({theta0}) + {width} * {i} / {n})"
    weight = f"(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    norm = f"exp(lgamma((({d1})+({d2}))/2.0) - lgamma(({d1})/2.0) - lgamma(({d2})/2.0))"
    inner = f"pow(sin({at}), ({d1}) - 1) * pow(greatest(cos({at}), 0.0), ({d2}) - 1) * {weight}"
    return f"(2 * {norm} * {width} / (3.0 * {n}) * list_sum(list_transform(range(0, {n + 1}), lambda i: {inner})))"


def t_tail_sql(t: str, df: str) -> str:
    """P(T > |t|)."""
    return f"(0.5 * {beta_tail_sql(f'atan(abs({t}) / sqrt({df}))', '1.0', df)})"


def f_tail_sql(f: str, d1: str, d2: str) -> str:
    return beta_tail_sql(f"atan(sqrt(({d1}) * ({f}) / ({d2})))", d1, d2)


def chi2_tail_sql(x: str, k: str, n: int = 600) -> str:
    i = "CAST(i AS DOUBLE)"
    at = f"(sqrt({x}) + 12.0 * {i} / {n})"
    weight = f"(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    # The exponent stays inside exp() so that large statistics do not overflow.
    inner = f"exp((({k}) - 1) * ln(greatest({at}, 1e-300)) - {at} * {at} / 2 - ({k})/2.0 * ln(2.0) - lgamma(({k})/2.0)) * {weight}"
    return f"(2 * 12.0 / (3.0 * {n}) * list_sum(list_transform(range(0, {n + 1}), lambda i: {inner})))"


def z_tail_sql(z: str) -> str:
    """P(Z > z) for a positive z."""
    return f"(0.5 * {chi2_tail_sql(f'(({z})*({z}))', '1.0')})"


def key_hash_sql(key: str, *salts: str) -> str:
    parts = ", ".join(f"CAST({s} AS BIGINT)" for s in (key, *salts))
    return f"CAST('0x' || substr(md5(concat_ws(':', {parts})), 1, 15) AS BIGINT)"
