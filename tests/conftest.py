import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from salesengine.session import get_spark

    s = get_spark("local[4]", shuffle_partitions=8, app="salesengine-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables01(spark):
    from salesengine.sources.warehouse import load_tables

    return load_tables(spark, SF01)
