import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tradewake.session import build_session  # noqa: E402

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cores=os.environ.get("TEST_CPUS", "8"), shuffle_partitions=8)


@pytest.fixture(scope="session")
def sf_dir():
    return f"{TESTDATA}/sf{os.environ.get('TEST_SF', '0.01')}"
