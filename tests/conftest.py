import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from osnowa.session import open_session

    s = open_session("tests", "local[4]", **{
        "spark__sql__shuffle__partitions": "4", "spark__driver__memory": "4g", "spark__checkpoint__dir": tmp_path_factory.mktemp("shared").as_uri(),
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
