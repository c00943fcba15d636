import pytest

from inkwell.plans.catalogue import ORACLE_SQL, QUERIES

from .oracle import compare, connect


@pytest.fixture(scope="module")
def con(mid):
    return connect(mid)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, mid, con, name):
    compare(con, QUERIES[name](spark, mid), ORACLE_SQL[name])
