import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(__file__), os.path.dirname(os.path.dirname(__file__))]


@pytest.fixture(scope="session")
def spark():
    from tarnfold.session import local_session

    session = local_session("tests", cores=8, memory="8g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
