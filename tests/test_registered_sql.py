"""Every query with SQL gives the rows that DuckDB gives, at the smallest size."""

import math
import os

import duckdb
import pytest

from benchlens.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else 0.0 if abs(v) < 1e-9 else float(f"{v:.9g}")
    return float(v) if not isinstance(v, list | dict) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([norm(r[i]) for i in order] for r in data), key=lambda r: [(x is None, isinstance(x, str), x if isinstance(x, str) else float(f"{x:.6g}") if x is not None else 0) for x in r])


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-7))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equal(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    want = rows(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want) > 0
    for g, w in zip(got, want, strict=True):
        assert all(map(same, g, w)), (g, w)
