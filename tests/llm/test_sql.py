import pytest

from inkwell.llm.registry import ORACLE_SQL, QUERIES

from ..oracle import compare, connect


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - {"op6_warc"}))
def test_query_matches_sql(spark, small, name):
    compare(connect(small), QUERIES[name](spark, small), ORACLE_SQL[name])
