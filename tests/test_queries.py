"""Every registered query against its SQL counterpart on the given tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tagloom.plans.oracles import ORACLES
from tagloom.plans.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not FOLDER.is_dir(), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_a_counterpart():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", entry.oracle_sql())
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, str(FOLDER))
    result = tables.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    wanted = sorted(map(repr, (dict(sorted(zip(columns, r))) for r in result.fetchall())))
    found = sorted(repr(dict(sorted(r.asDict().items()))) for r in df.collect())
    assert found == wanted


def test_entry(spark):
    assert entry.entry(spark).count() > 0
