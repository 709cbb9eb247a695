import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from probeweave.session import build_session

    s = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('steps')}", "spark.sql.warehouse.dir": f"file://{tmp_path_factory.mktemp('warehouse')}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
