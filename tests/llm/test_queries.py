"""Registered queries against their SQL on the smallest tables."""
import pytest

from raregrain.llm.queries import ORACLES, QUERIES

from .helpers import duck, rows_of


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert rows_of(QUERIES[name](spark, sf)) == duck(ORACLES[name], sf)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
