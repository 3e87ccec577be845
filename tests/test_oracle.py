"""Every registered query against its SQL."""

import pytest

from checks.compare import compare, given_tables
from checks.oracle import ORACLE
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def connection(folder):
    return given_tables(folder)


# A trained model; tests/test_learned.py holds it against what it was trained on.
NO_SQL = {"score_learned"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) | NO_SQL


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, connection, folder, name):
    count, faults = compare(spark, connection, folder, name)
    assert not faults
    assert count > 0


def test_comparison_notices_a_difference(spark, connection, folder, monkeypatch):
    monkeypatch.setitem(ORACLE, "list_phrases", "SELECT 'Food' AS Phrase")
    assert compare(spark, connection, folder, "list_phrases")[1]


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 25
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
