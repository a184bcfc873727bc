"""Every checked query against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "date": "DATE", "boolean": "BOOLEAN"}
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables not there")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def _sorted(rows, order):
    return sorted(
        (tuple(r[i] for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r]
    )


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(FOLDER))
    rows = df.collect()
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    kinds = {r[0]: r[1] for r in duck.execute("DESCRIBE " + ORACLES[name]).fetchall()}
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    order = sorted(df.columns)
    got = _sorted(rows, [df.columns.index(c) for c in order])
    assert got == _sorted(want, [names.index(c) for c in order])
    assert got


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == [
        "series", "Time", "dt_event", "Median", "LI", "LS", "LIb", "LSb",
    ]
    assert result.count() == 75
