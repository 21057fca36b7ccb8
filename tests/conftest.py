import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from paircast.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def log(spark, sf_dir, tmp_path_factory):
    """The derived game log, stored once for the whole run."""
    from paircast.workload.tables import game_log

    path = str(tmp_path_factory.mktemp("log") / "log")
    game_log(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)
