"""Every query with SQL agrees with DuckDB row by row over the whole tables; every other one runs."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from cohortloom.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, "" if isinstance(v, (int, float)) else str(type(v)), 0 if v is None else v) for v in row)


def _same(a, b):
    # The data are tiny here, so exact ties of rounding occur; a unit of the last digit is allowed.
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-4, abs_tol=1.1e-4)
    return a == b


def _match(got, want):
    """Whether rows with equal plain columns can be paired so that all their numbers agree."""
    left = list(want)
    for row in got:
        at = next((i for i, other in enumerate(left) if all(map(_same, row, other))), None)
        if at is None:
            return False
        left.pop(at)
    return not left


def _by_plain(rows, floats):
    """Rows by their columns that are not floating, which must agree exactly."""
    out = {}
    for r in rows:
        out.setdefault(tuple(v for v, f in zip(r, floats) if not f), []).append(tuple(v for v, f in zip(r, floats) if f))
    return out


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    cols = sorted(df.columns)
    floats = [df.schema[c].dataType.typeName() in ("double", "float") for c in cols]
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()]
    assert len(got) == len(want)
    a, b = _by_plain(got, floats), _by_plain(want, floats)
    assert a.keys() == b.keys()
    assert [k for k in a if not _match(sorted(a[k], key=_key), sorted(b[k], key=_key))] == []


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql is None))
def test_query_without_sql_runs(spark, name):
    rows = entry_module.queries()[name](spark, SF).collect()
    assert rows
    assert not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"network", "n_positive", "n_negative", "n", "mean_t"}


def test_every_query_is_in_the_registry_once():
    assert set(SQL) <= set(entry_module.queries())
