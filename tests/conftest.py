import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from swellcast.session import get_spark
    s = get_spark("local[4]", 4, extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="swellcast-test-ckpt-")})
    yield s


@pytest.fixture(scope="session")
def con():
    from swellcast.plans.check import duck
    return duck(SF_ORACLE)
