import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from flowlucid.config import build_session  # noqa: E402
from flowlucid.plans.workbench import workbench  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("flowlucid-tests", cpus=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bench(spark):
    return workbench(spark, SMALL)
