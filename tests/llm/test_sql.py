"""The training-data queries that have SQL give the rows of their SQL."""

import duckdb
import pytest

from snaptrail.llm import queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_rows_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, sql = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    mine = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert mine == sorted(repr(r) for r in sql.project(", ".join(columns)).fetchall()) and mine
