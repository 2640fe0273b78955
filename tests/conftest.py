import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from postlens.session import build_session
    scratch = tempfile.mkdtemp(prefix="postlens-tests-")
    s = build_session(master="local[*]", app_name="postlens-tests", shuffle_partitions=8,
                      read_partitions=4,
                      checkpoint_dir=os.path.join(scratch, "ckpt"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="postlens-t-")
