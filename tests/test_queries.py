import pytest

from lectern.queries import ORACLE_SQL, QUERIES

from .compare import canonical, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = canonical(QUERIES[name](spark, SF).toPandas()), canonical(duck.sql(ORACLE_SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert ours.equals(theirs)
