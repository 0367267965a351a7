import pytest

from tests.oracle import compare
from tidemark.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF) == ""


def test_names_are_in_order():
    numbers = [int(n.split("_")[0][2:]) for n in queries.queries() if n.startswith("op")]
    assert numbers == list(range(1, 14))
