import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from revlens.session import get_spark

    s = get_spark("local[4]", 4, extra_conf={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="revlens-test-")})
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"
