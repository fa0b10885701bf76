"""Queries against their SQL twins over whole small tables."""

import duckdb
import pytest

from salesmart.llm import queries

TABLES = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    columns = [column[0] for column in result.description]
    theirs = result.fetchall()
    ours = queries.queries()[name](spark, TABLES)
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(map(tuple, ours.select(columns).collect())) == sorted(theirs)
