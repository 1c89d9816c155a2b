"""Every query against its SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as contract
from compare import compare, duck
from driftgate.checks import queries as registry

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


def test_every_query_of_the_tables_has_its_sql():
    """Operators on training text that no SQL can state are tested against brute force, beside them."""
    lacking = set(contract.queries()) - set(contract.oracle_sql())
    assert all(name.startswith("op") or name == "pipeline" for name in lacking)
    assert not lacking & set(registry.QUERIES) and set(contract.oracle_sql()) <= set(contract.queries())


@needs_data
def test_entry(spark):
    assert contract.entry(spark).count() == 10


@needs_data
@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query_agrees(spark, connection, name):
    good, note = compare(spark, connection, SMALL, name)
    assert good, note
