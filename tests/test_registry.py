"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
from oracle_check import compare, connect

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, sf_dir, name):
    verdict, _, rows = compare(spark, con, sf_dir, QUERIES[name], ORACLES.get(name))
    assert verdict in ("ok", "rows-only")
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    (row,) = entry_point.entry(spark).collect()
    assert (row.exact_match, row.correct, row.error_class) == (0, 1, "")
