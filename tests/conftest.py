import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tapeloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", partitions=4, memory="6g")


@pytest.fixture
def split(spark):
    """Force the split way: every group counts as too big for one task."""
    from tapeloom.scale import LIMIT_KEY

    spark.conf.set(LIMIT_KEY, "3")
    yield
    spark.conf.unset(LIMIT_KEY)
