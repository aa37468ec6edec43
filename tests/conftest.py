import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from weftline.session import local_session

    with tempfile.TemporaryDirectory() as warehouse:
        conf = {"spark__sql__shuffle__partitions": "2", "spark__driver__memory": "4g", "spark__sql__warehouse__dir": warehouse}
        session = local_session(4, "weftline-tests", **conf)
        yield session
        session.stop()
