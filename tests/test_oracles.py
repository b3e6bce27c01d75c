"""Every query with an oracle gives exactly the oracle's rows."""

import pytest

import __spark_entry__ as contract
from workloads.compare import spark_rows, sql_rows

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, sf_dir, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
    expected_columns, expected = sql_rows(duck, ORACLES[name])
    assert columns == expected_columns
    assert not rows - expected, list((rows - expected))[:3]
    assert not expected - rows, list((expected - rows))[:3]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle_is_complete_sql(duck, name):
    duck.execute("EXPLAIN " + ORACLES[name])


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
