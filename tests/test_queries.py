"""Every query with SQL gives the rows of its SQL."""

import duckdb
import pytest

from snaptrail.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") and v.tzinfo else v


@pytest.fixture(scope="session")
def oracle(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_rows_equal_sql(spark, sf_dir, oracle, name):
    df, sql = registry.queries()[name](spark, sf_dir), oracle.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    mine = sorted(repr([plain(v) for v in r]) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    theirs = sorted(repr([plain(v) for v in r]) for r in sql.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
