"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from antipode.plans import ORACLE, QUERIES
from tools.check_queries import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, text, _ = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_DIR)
    assert ok, text
