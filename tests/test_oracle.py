"""Every registered query with SQL gives the same rows as that SQL in DuckDB."""

import decimal
import os

import __spark_entry__ as contract
import duckdb
import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_rows(spark, db, name):
    got = contract.queries()[name](spark, SF_DIR)
    result = db.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(([plain(r[columns.index(c)]) for c in order] for r in result.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in order] for r in got.collect()), key=repr) == want
