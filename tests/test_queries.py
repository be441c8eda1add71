import os

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, compare

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no fixture tables")


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, name, FOLDER).startswith("ok")


def test_every_query_has_sql():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 2
