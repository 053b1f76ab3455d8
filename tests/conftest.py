"""One local session for all tests."""

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quillon.session import local_session

    os.environ.setdefault("SPARK_LOCAL_DIRS", tempfile.mkdtemp(prefix="spark-"))
    return local_session(8, 8)


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("QUILLON_TEST_SF", "/root/testdata/sf0.001")
