"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import check
import pytest

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def connection(sf_dir):
    return check.oracle(sf_dir)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, connection, sf_dir, name):
    ok, message = check.compare(spark, connection, sf_dir, name)
    assert ok, message


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
