"""Every registered query that has SQL, against DuckDB."""

import pytest

from compare import DATA, connect, same
from helmsight import queries as reference

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(reference.oracle_sql()))
def test_query(spark, con, name):
    same(reference.queries()[name](spark, SF), con, reference.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(reference.queries()) == set(reference.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
