import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from paytrail.session import checkpoint_root, get_spark
    s = get_spark("local[4]", 4, app_name="paytrail-tests", driver_memory="6g")
    checkpoint_root(s)
    yield s


@pytest.fixture(scope="session")
def raw(spark):
    from paytrail.sources.tables import RawTables
    return RawTables(spark, SF_SMALL)
