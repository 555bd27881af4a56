"""Every core query that SQL can express gives the rows that its SQL gives."""

import datetime
import os
from pathlib import Path

import duckdb
import pytest

from millrace.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables aren't here")


def plain(x):
    return x.isoformat() if isinstance(x, datetime.date) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    mine = queries.QUERIES[name](spark, SF)
    theirs = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(columns)
    got = sorted([tuple(plain(x) for x in r) for r in mine.select(*columns).collect()], key=repr)
    want = sorted([tuple(plain(x) for x in r) for r in theirs.fetchall()], key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
