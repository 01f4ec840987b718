import pytest

from factloom.runtime import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", 4, 4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()
