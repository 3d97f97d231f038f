import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from partloom.session import build_session

    os.environ.setdefault("PARTLOOM_DRIVER_MEMORY", "4g")
    s = build_session("partloom-tests", master="local[4]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
