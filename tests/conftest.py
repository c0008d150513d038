import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tablewright.session import local_session, shared_dir

    session = local_session(8, "tests")
    shared_dir(session)
    return session
