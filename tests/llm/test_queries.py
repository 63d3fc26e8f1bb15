"""Every registered query of the subpackage: rows, columns, and its SQL where it has one."""

import duckdb
import pytest

from veilspark.llm import CHECK_SQL, QUERIES

SF = "/root/testdata/sf0.001"
# rows of the result for each row of a table, if not one for each document; words have no such number
ROWS = {"op1_warc": ("pages", 1), "page_language": ("pages", 1), "op12_whitening": ("embeddings", 8), "op13_spelling": ("documents", 0)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    table, times = ROWS.get(name, ("documents", 1))
    if times:
        assert len(got) == times * spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in CHECK_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cur = con.execute(CHECK_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert sorted(got, key=str) == sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=str)
