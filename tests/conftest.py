import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from fieldtally.session import build_session

    shared = str(tmp_path_factory.mktemp("shared"))
    session = build_session("tests", "local[4]", 4, "4g", shared)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
