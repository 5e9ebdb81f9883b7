import pytest

from quire.llm.shared import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    """Workers import the package."""
    ship(spark)
