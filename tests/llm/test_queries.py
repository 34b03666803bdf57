import pytest

from tests.oracle import connect, same
from tidemark.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = [d[0] for d in con.execute(f"SELECT * FROM ({ORACLE[name]}) LIMIT 0").description]
    same(df.select(*cols), ORACLE[name], con)
