"""Every registered query against its SQL counterpart, and the shape of the contract."""

import re

import oracle
import pytest

import __spark_entry__ as contract

QUERIES = contract.queries()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def connection(small):
    return oracle.duck(small)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    # Those of the training-data subpackage have tests of their own.
    own = {name for name in QUERIES if not re.match(r"op\d+_|pipeline$", name)}
    assert own - set(SQL) == {"m5_fit"}


def test_entry_has_rows(spark):
    rows = contract.entry(spark)
    assert rows.count() > 0
    assert {"day", "segment_id", "probability"} <= set(rows.columns)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, connection, small, name):
    assert oracle.compare(spark, connection, name, QUERIES[name], SQL[name], small) is None
