"""Every query with SQL gives what DuckDB gives on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestrata.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(([str(plain(r[i])) for i in order] for r in records))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = df.collect()
    if name in ORACLE_SQL:
        expected = duck.sql(ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(expected.columns)
        assert rows(found, df.columns) == rows(expected.fetchall(), expected.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
