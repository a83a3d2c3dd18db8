import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from hearth.session import build_session
    s = build_session("local[*]", app="hearth-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    # Tests run locally, where spark.checkpoint.dir is unset: use a scratch folder.
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hearth-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="hearth-test-")
