import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from seriesloom.session import local_session

    s = local_session("4", 4)
    s.sparkContext.setLogLevel("OFF")
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
