import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from roadspeed.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 8, extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="rs-test-ckpt-")})
    yield s
    s.stop()
