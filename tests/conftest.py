import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from lineforge.session import build_session
    s = build_session("local[*]", shuffle_partitions=8, app="lineforge-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="lf-test-ckpt-"),
                             "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="lf-test-")


def one_col(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")
