import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fintally.session import get_session
    ckpt = tempfile.mkdtemp(prefix="fintally-test-ckpt-")
    s = get_session("local[4]", 4, extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "6g",
                                           "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1"})
    yield s


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="fintally-test-")


SF_SMALL = "/root/testdata/sf0.001"
