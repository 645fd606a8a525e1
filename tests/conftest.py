import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from bidscope.session import local_session, shared_dir
    s = local_session("*", 8)
    shared_dir(s)
    yield s
    s.stop()
