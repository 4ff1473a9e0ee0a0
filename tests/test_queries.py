"""Every query that has SQL gives the rows of its SQL."""

import pytest

import __spark_entry__ as entry
from recollect.plans import queries as own
from recollect.plans import service, upkeep  # noqa: F401
from tests.oracle import connect, rows


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_matches_sql(spark, sf, con, name):
    got = own.queries()[name](spark, sf).toPandas()
    want = con.execute(own.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
