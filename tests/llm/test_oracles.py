"""Registered queries of the subpackage: their SQL on DuckDB, and names."""

import duckdb
import pytest

import __spark_entry__ as entry_mod
from paytrail.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def _rows(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall()
    assert _rows(tuple(r) for r in df.select(*cols).collect()) == _rows(want)


def test_all_are_registered():
    names = entry_mod.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
