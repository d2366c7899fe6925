import pytest

from sparkwarden.llm.queries import oracle_sql, queries
from tests.oracle import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    check(spark, con, queries()[name], oracle_sql()[name], SF)
