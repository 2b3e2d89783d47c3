"""Every query with SQL gives the rows of its SQL; every other one gives rows."""

import oracle
import pytest

from codicil.plans import CATALOGS

QUERIES = {n: q for c in CATALOGS for n, q in c.queries.items()}
SQL = {n: s for c in CATALOGS for n, s in c.sql.items()}


@pytest.fixture(scope="module")
def db(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, db, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        assert oracle.differences(df, db, SQL[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
