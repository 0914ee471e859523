import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortgrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("SF_DIR", "/root/testdata/sf0.001")
