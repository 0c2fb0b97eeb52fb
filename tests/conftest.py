import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quirespark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", shuffle_partitions="4", **{"spark.driver.memory": "4g"})
    yield session
    session.stop()
