"""Registered training-data queries with a SQL twin agree with DuckDB."""

import math

import duckdb
import pytest

from quarry.llm.catalog import ORACLE_SQL, QUERIES
from quarry.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    mine = sorted(repr([_norm(r[c]) for c in sorted(cols)]) for r in df.collect())
    at = {c: i for i, c in enumerate(cols)}
    assert mine == sorted(repr([_norm(r[at[c]]) for c in sorted(cols)]) for r in cur.fetchall())
