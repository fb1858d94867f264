"""Queries of this subpackage that SQL can express, against DuckDB."""

import duckdb
import pytest

from dossier.llm.queries import SQL, queries


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    out = con.execute(SQL[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == cols
    assert got == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in out.fetchall())
