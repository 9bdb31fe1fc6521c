import pytest
from compare import oracle, same

from weftline.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLE[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and len(QUERIES) == 60
