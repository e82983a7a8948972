"""Every registered query of the engine gives the rows of its SQL; those without SQL give rows."""

import math

import duckdb
import pytest

from tidemark.plans.catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 9) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, duck, name):
    df = QUERIES[name](spark, tiny)
    names = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    if name not in ORACLE:
        assert rows
        return
    out = duck.sql(ORACLE[name])
    at = [out.columns.index(c) for c in names]
    assert sorted(out.columns) == names
    assert rows == sorted(repr([plain(r[k]) for k in at]) for r in out.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
