import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from paperloom.session import local_session

    s = local_session(4, 4, spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()
