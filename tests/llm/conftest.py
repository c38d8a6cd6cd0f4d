import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import cases  # noqa: E402


@pytest.fixture(scope="session")
def messy(spark):
    return cases.documents(spark, cases.messy()).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return cases.documents(spark, [])
