import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parvis.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "parvis-tests", driver_memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def one_row(spark):
    """Evaluate columns over a single row."""

    def evaluate(*cols):
        row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
        return row[0] if len(cols) == 1 else tuple(row)

    return evaluate
