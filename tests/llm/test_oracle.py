"""Queries that SQL can express give DuckDB's rows."""

import duckdb
import pytest

from benchlens.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equal(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    result = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    got = queries.QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, result.fetchall()))


def test_all_numbered_queries_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
