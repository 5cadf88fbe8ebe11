import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quarry.session import local_session

    s = local_session(8, app="quarry-tests", **{"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)


@pytest.fixture(autouse=True, scope="module")
def _clear_scratch(spark):
    yield
    from quarry.session import clear_scratch

    clear_scratch(spark)
