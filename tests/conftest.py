import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cohortica.session import session
    from cohortica.streaming.events import STREAM_SETTINGS

    work = tmp_path_factory.mktemp("spark")
    s = session(
        "local[4]", **STREAM_SETTINGS,
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(work / "warehouse"),
           "spark.checkpoint.dir": f"file://{work}/shared", "spark.driver.memory": "3g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
