import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cabmart.session import local_session
    s = local_session("*", shuffle_partitions=8, app="cabmart-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="cabmart-test-ckpt-"),
                             "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="cabmart-test-wh-")})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="cabmart-test-")
