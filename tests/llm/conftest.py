import pytest
from gitgauge.llm.queries import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def docs(spark):
    """docs((doc_id, text), ...) with columns whose names clash with those that operators make."""
    def make(*rows):
        return spark.createDataFrame(
            [(i, t, "x", 1, None) for i, t in rows], "doc_id bigint, text string, hash string, score int, block string")
    return make
