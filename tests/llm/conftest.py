import pytest

from tuplewise.llm.common import small_batches


@pytest.fixture(autouse=True)
def workers(spark):
    small_batches(spark)
