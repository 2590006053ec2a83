"""Every query on the smallest tables, against its SQL where there is one."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as catalogue

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from compare import same  # noqa: E402

SF_DIR = Path("/root/testdata/sf0.001")
QUERIES = catalogue.queries()
SQL = catalogue.oracle_sql()

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    got = QUERIES[name](spark, str(SF_DIR)).toPandas()
    assert len(got)
    if name in SQL:
        assert same(got, db.execute(SQL[name]).df()) == "same"


def test_entry(spark):
    result = catalogue.entry(spark)
    assert result.columns[0] == "p_partkey" and result.count() > 0
