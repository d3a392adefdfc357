"""The cluster settings size partitions only: results are the same under them."""

import pytest

import __spark_entry__ as E
from salesengine.session import SCALE_SETTINGS, configure_for_scale
from tests.conftest import SF001

KEYS = ["product_sales_window", "customer_retention", "inventory_anomalies", "territory_best_product",
        "identity_assign"]


@pytest.fixture()
def scaled(spark):
    s = spark.newSession()  # own SQL conf; shares the context
    configure_for_scale(s, **{"spark.sql.shuffle.partitions": "512",
                              "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512"})
    return s


def test_scale_settings_are_applied(scaled):
    for k in ("spark.sql.adaptive.forceOptimizeSkewedJoin", "spark.sql.files.maxPartitionBytes"):
        assert scaled.conf.get(k) == SCALE_SETTINGS[k]


@pytest.mark.parametrize("key", KEYS)
def test_same_results_under_scale_settings(spark, scaled, key):
    a = E.queries()[key](spark, SF001)
    b = E.queries()[key](scaled, SF001)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
