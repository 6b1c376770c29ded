import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from noteflare.session import build_local

    s = build_local(cpus=8, shuffle_partitions=8, app="noteflare-tests")
    yield s
    s.stop()
