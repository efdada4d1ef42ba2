import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from voxelloom.session import local_session, ship

    s = local_session(2, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    ship(s)
    yield s
    s.stop()
