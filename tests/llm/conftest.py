import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from tests_llm_helpers import SCHEMA, rows  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def unique(spark):
    """Rows with a key of their own each."""
    return spark.createDataFrame([r for r in rows()[:17]], SCHEMA)
