import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from nearhit.session import get_session
    s = get_session("local[8]", 8)
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="nearhit-test-ckpt-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="nearhit-test-", dir="/tmp")
