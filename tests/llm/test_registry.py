import pytest
from compare import oracle, same

from weftline.llm import registry

SF = "/root/testdata/sf0.001"


def test_each_operator_has_one_query():
    names = sorted(registry.queries())
    assert [n for n in range(1, 11) if sum(x.startswith(f"op{n}_") for x in names) == 1] == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(registry.queries()[name](spark, SF), oracle(SF), registry.oracle_sql()[name])
