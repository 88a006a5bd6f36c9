"""Every registered query against its DuckDB SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from meshlark.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def close(a, b):
    return all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, tables, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    sql = registry.oracle_sql().get(name)
    assert got
    if sql:
        found = tables.sql(sql)
        assert sorted(found.columns) == columns
        want = sorted((tuple(map(plain, r)) for r in tables.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()), key=str)
        assert len(got) == len(want) and all(map(close, got, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
