"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lumenfold import build_session
    from lumenfold.session import EngineConfig

    extra = {"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    session = build_session("tests", "local[4]", EngineConfig(shuffle_partitions=4, extra=extra))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
