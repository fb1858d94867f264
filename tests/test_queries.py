"""Each query with SQL against DuckDB on the smallest tables, and each without it for its rows."""

from pathlib import Path

import duckdb
import pytest

from dossier.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Whole-graph text or figures that hold no row on tables this small.
MAY_BE_EMPTY = {"q_inferred_edges", "ga_gaps", "snk_doc_delete", "er_fuzzy", "x_phase2", "ga_homology", "ga_bridges", "er_cosine", "j_block_reg", "j_block_nameaddr", "f_verdict", "agg_cross", "f_find_entity"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def same(x):
    return repr(x) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(tuple(map(same, r)) for r in df.select(*cols).collect())
    out = duck.execute(SQL[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(same(r[i]) for i in at) for r in out.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(name, spark, small):
    rows = QUERIES[name](spark, small).collect()
    assert rows or name in MAY_BE_EMPTY


def test_entry_imports():
    text = (Path(__file__).resolve().parents[1] / "__spark_entry__.py").read_text()
    assert "def entry" in text and "def queries" in text and "def oracle_sql" in text
