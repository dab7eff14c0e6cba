"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle
from feedcore.catalog.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


# Queries of the separate package have tests of their own.
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    count, problems = oracle.compare(df, entry.oracle_sql()[name], con)
    assert not problems
    assert count > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_flagship(spark):
    assert entry.entry(spark).count() == 100
