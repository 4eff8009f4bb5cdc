import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from eventloom.session import build_session

    session = build_session("tests", cores=4, shuffle_partitions=4, memory="6g")
    if not session.conf.get("spark.checkpoint.dir", None):
        root = str(tmp_path_factory.mktemp("checkpoint"))
        session.conf.set("spark.checkpoint.dir", root)
        session.sparkContext.setCheckpointDir(root)
    yield session
    session.stop()
