"""Queries of the corpus operators against their SQL in DuckDB."""

import os

import duckdb
import pytest

from roamframe.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_matches_sql(name, spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations"):
        p = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    df = QUERIES[name](spark, sf)
    found = c.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    want = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    assert sorted(str([r[x] for x in columns]) for r in df.collect()) == sorted(str([r[x] for x in columns]) for r in want)
