import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from runledger.session import get_session
    s = get_session("local[4]", 8, app_name="runledger-tests",
                    extra={"spark.driver.memory": "4g",
                           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="runledger-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)
