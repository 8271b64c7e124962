import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quern.session import get_spark, ship

    s = get_spark("local[4]", 4, "3g", spark__sql__execution__arrow__maxRecordsPerBatch="500", spark__ui__showConsoleProgress="false", spark__sql__maxMetadataStringLength="2000")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    path = os.environ.get("QUERN_TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path
