import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from inkweave.sources.session import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("4", 4, **{"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
