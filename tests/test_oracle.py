"""Every registered query against its SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check_queries import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        message = compare(df, duck, ORACLES[name])
        assert message.startswith("ok") and "TYPES" not in message, message
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
