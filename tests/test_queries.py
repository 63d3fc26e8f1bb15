"""Every registered query against its check SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from tests.conftest import SF

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        cur = con.execute(SQL[name])
        assert got == check.rows_of([d[0] for d in cur.description], cur.fetchall())
    else:
        assert got[1]


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["lang", "pii_type", "findings", "affected"] and df.count() > 0
