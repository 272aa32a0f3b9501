import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paths import SF01  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from quarry.session import build_session
    s = build_session(master="local[8]", app="quarry-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck01():
    from oracle_check import duck_connection
    return duck_connection(SF01)
