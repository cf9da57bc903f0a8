import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tracefold.session import build_session, checkpoint_dir
    s = build_session(master="local[4]", app="tracefold-tests", shuffle_partitions=8)
    checkpoint_dir(s)  # tests set their own checkpoint folder (unset locally)
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tracefold-test-")
