import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from skein.session import local_session

    session = local_session("tests", **{"spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "8"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.01"
