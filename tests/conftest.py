import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from chronofold.session import spark_session

    s = spark_session("tests", 4, **{"spark.driver.memory": "3g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    path = DATA / "sf0.001"
    if not path.exists():
        pytest.skip("no test data")
    return str(path)
