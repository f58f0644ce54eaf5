import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import check  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return check.session(8, shuffle_partitions=4)
