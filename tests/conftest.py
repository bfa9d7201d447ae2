"""One local session for all tests."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
from helpers import SF  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from mnemoloom.session import build

    shared = tmp_path_factory.mktemp("shared")
    session = build("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"file://{shared}/warehouse"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return SF
