"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from conftest import SF_SMALL
from paytrail.plans.registry import QUERIES as OWN

# the library's own queries; those of the optional subpackage are tested in tests/llm
QUERIES = {k: f for k, f in entry_mod.queries().items() if k in OWN}
ORACLE = {k: q for k, q in entry_mod.oracle_sql().items() if k in OWN}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


def test_every_query_has_an_oracle_or_is_documented():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _canon(df.columns, rows) == _canon(ocols, res.fetchall())


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() == 1
