import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dragoman.session import get_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = str(tmp_path_factory.mktemp("scratch"))
    session = get_session("tests", cpus=8, **{"spark.checkpoint.dir": scratch})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
