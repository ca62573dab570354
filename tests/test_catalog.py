"""Every registered query beside its SQL on DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, name):
    verdict, rows, _ = compare(spark, sf, name, QUERIES[name], ORACLES.get(name))
    assert verdict in ("ok", "rows")
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
