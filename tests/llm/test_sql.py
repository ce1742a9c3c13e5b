"""Corpus queries with SQL, against it, on the small data."""

import pytest

from ticketloom.checks.compare import compare
from ticketloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    r = compare(spark, small, name, QUERIES[name], ORACLES[name])
    assert r["ok"], r["why"]
