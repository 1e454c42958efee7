import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from evtide.session import session, ship

    s = session("local[4]", partitions=4, **{"spark.ui.enabled": "false"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s


@pytest.fixture(scope="session")
def base():
    return "/root/testdata/sf0.001"
