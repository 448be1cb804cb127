from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from placeloom.session import session

    made = session(
        "local[4]", 4,
        spark_driver_memory="4g", spark_ui_showConsoleProgress="false", spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")),
        spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


DATA = "/root/testdata"


@pytest.fixture(scope="session")
def sf_dir():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path
