"""Every registered query with SQL must equal it, row by row, on the given tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import FOLDER
from tests.parity import connect, difference

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


def test_sql_is_registered():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, folder, database, name):
    ours = QUERIES[name](spark, folder).toPandas()
    theirs = database.execute(SQL[name]).df()
    assert difference(ours, theirs) == ""
    assert len(ours) > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 40
