import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from dealgrid.session import get_session
    s = get_session("local[*]", shuffle_partitions=8, app_name="dealgrid-tests")
    yield s


@pytest.fixture(scope="session")
def crm(spark):
    from dealgrid.plans.catalog import crm_for
    return crm_for(spark, SF_SMALL)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)
