"""Every registered query beside its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.compare import compare, duck
from workloads import registry

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con(request):
    return duck("/root/testdata/sf0.001")


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["session_id", "event_id", "t_us", "ratio", "epoch", "last_bucket", "fired_bucket"]
    assert df.count() == 296


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, sf_dir, key):
    err, n = compare(spark, con, QUERIES[key], SQL[key], sf_dir)
    assert err is None
    assert n > 0
