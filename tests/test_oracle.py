"""Every registered query against its SQL, over the whole smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from tiepoints.plans.oracle import ORACLE
from tiepoints.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    result, _ = compare(spark, con, SF, name)
    assert result.startswith("ok") and result != "ok 0 rows"


def test_entry(spark):
    assert entry.entry(spark).count() == 9


def test_every_query_of_the_library_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())
