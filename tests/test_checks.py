"""Every registered query against its SQL, on the small data."""

import pytest

from ticketloom.checks import ORACLES, QUERIES
from ticketloom.checks.compare import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    r = compare(spark, small, name, QUERIES[name], ORACLES[name])
    assert r["ok"], r["why"]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
