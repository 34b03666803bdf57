import pytest

from tests.oracle import connect, same
from tidemark.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        same(df, ORACLE[name], con)
    else:
        assert df.count() > 0
