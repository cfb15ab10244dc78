import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomlog.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=int(os.environ.get("TEST_CPUS", "8")), name="loomlog-tests")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
