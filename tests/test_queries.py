"""Every registered query against its SQL, and the driver contract."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry_module
from ticketmill.plans import registry

TABLES = "/root/testdata/sf0.001"
QUERIES = registry.QUERIES
CHECKS = registry.CHECKS


@pytest.fixture(scope="module")
def con():
    return duck(TABLES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    df = QUERIES[key](spark, TABLES)
    if key in CHECKS:
        assert differences(df, CHECKS[key], con) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_checks_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
