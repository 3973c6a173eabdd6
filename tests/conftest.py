import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tarnwork.session import local_session

    os.environ["TARNWORK_LOCAL_DIR"] = str(tmp_path_factory.mktemp("shared"))
    s = local_session("tests", cores="4", shuffle="4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
