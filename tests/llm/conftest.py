import pytest

from tidemark.llm import storage


@pytest.fixture(scope="session", autouse=True)
def _released(spark):
    yield
    storage.release(spark)
