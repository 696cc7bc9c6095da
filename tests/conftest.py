import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from runnel.session import session

    return session("local[8]", "tests", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("the synthetic tables are not there")
    return DATA
