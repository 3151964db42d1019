import pytest


@pytest.fixture(autouse=True)
def shipped(spark):
    from plinth.llm.common import ship

    ship(spark)
