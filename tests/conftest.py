import pytest

from veilwork.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(
        4,
        spark__sql__shuffle__partitions="4",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("wh")),
    )
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ck")))
    yield s
