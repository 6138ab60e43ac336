import pytest

from cohortloom.llm.common import prepare


@pytest.fixture(scope="session")
def corpus_spark(spark):
    return prepare(spark)
