"""Every catalogue query against its SQL, on the smallest given tables."""

import os

import duckdb
import pytest

from evenkeel.plans.catalog import QUERIES
from evenkeel.plans.oracles import ORACLES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def ordered(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = ordered([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    want = ordered(result.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns)
    assert got == want
    # these tables are too small for the two plans to differ
    assert got or name == "plan_diff"
