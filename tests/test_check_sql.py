"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import __spark_entry__ as contract
import check_sql
import pytest
from comparing import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = check_sql.statements()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(contract.queries())


@pytest.mark.parametrize("name", list(contract.analyses()))
def test_query(spark, duck, name):
    frame = contract.queries()[name](spark, FOLDER)
    if name in SQL:
        assert compare(frame, duck, SQL[name]) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
