import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from stockbook.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", app="stockbook-tests", shuffle_partitions=4,
                  extra={"spark.driver.memory": "4g"})
    checkpoint_dir(s)
    yield s


@pytest.fixture(autouse=True)
def _drop_cached(request):
    yield
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").catalog.clearCache()
