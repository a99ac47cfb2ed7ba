"""Every query with SQL gives DuckDB's rows on the same tables; the others run."""

import oracle
import pytest

from tesserak.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
SF = oracle.sf("sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    names, rows = oracle.rows_of_df(QUERIES[name](spark, SF))
    if name in SQL:
        assert (names, rows) == oracle.rows_of_sql(con, SQL[name])
    else:
        assert names


def test_every_oracle_has_a_query():
    assert SQL.keys() <= QUERIES.keys()


def test_entry_module():
    import __spark_entry__ as e

    assert QUERIES.keys() <= e.queries().keys()
    assert e.oracle_sql().keys() <= e.queries().keys()
