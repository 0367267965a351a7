import pytest

from tests import service_queries
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(service_queries.QUERIES))
def test_run_over_a_service_equals_its_sql(spark, name):
    assert compare(service_queries.QUERIES[name](spark, SF), service_queries.ORACLES[name], SF) == ""
