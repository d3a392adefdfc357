
import datetime as dt

import pytest

from salesengine.functions.money import int_avg, money_avg
from salesengine.plans import customers, people, sales, supply
from salesengine.sources import adapters as A
from tests.brute import expected
from tests.fixtures import make_tables, nations, small_world

AS_OF = dt.date(2001, 8, 1)


@pytest.fixture(scope="module")
def world(spark):
    t = small_world(spark)
    sup = spark.createDataFrame([(1, "s1", 0, -7.5), (2, "s2", 1, 123.0), (4, "s4", 2, 55.9), (5, "s5", 0, 1.0)],
                                "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    t["supplier"] = sup
    return t


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_s1_integer_average_truncates_toward_zero(spark):
    df = spark.createDataFrame([(-7,), (0,), (None,)], "x int")
    assert df.agg(int_avg("x").alias("a")).first()["a"] == -3
    assert spark.createDataFrame([(None,)], "x int").agg(int_avg("x").alias("a")).first()["a"] is None


def test_s1_department_hours(world):
    got = rows(people.department_productivity(world), "DepartmentID", "TotalEmployees", "AvgVacationHours",
               "AvgSickLeaveHours")
    # dept 0: vacation -8 and 1 -> -7 div 2 = -3 (not -4); sick 1 and 5 -> 3
    assert got == [(0, 2, -3, 3), (1, 1, 23, 2), (2, 1, 55, 4)]


def test_s2_money_average_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame([("a", 1.0001), ("a", 1.0), ("b", -1.0001), ("b", -1.0), ("c", 2.5)],
                               "g string, x double")
    got = dict(rows(df.groupBy("g").agg(money_avg("x").alias("m")), "g", "m"))
    assert got == {"a": 1.0001, "b": -1.0001, "c": 2.5}


def test_s3_s9_inventory_counts_keep_fan_out(world):
    all_sales = rows(supply.inventory_anomalies(world), "ProductID", "InventoryQty", "SalesCount")
    assert all_sales == [(10, 200, 2)]
    recent = rows(supply.inventory_anomalies(world, sales_since=A.years_before(AS_OF, 1)),
                  "ProductID", "InventoryQty", "SalesCount")
    # product 11 has stock 0 and no sale in the window: COUNT(col) over the unmatched LEFT JOIN row is 0
    assert recent == [(10, 200, 2), (11, 0, 0)]


def test_s9_low_inventory_multiplies_stock_rows(world):
    got = rows(supply.low_inventory_sellers(world), "ProductID", "InventoryQty", "SalesCount")
    # product 12 has two stock rows with quantity 0 and two sales rows -> one group counting 4
    assert got == [(10, 1, 2), (11, 0, 1), (12, 0, 4)]


def test_s8_null_salesperson_dropped(world):
    got = rows(people.salesperson_performance(world), "SalesPersonID", "TotalOrders", "TotalSales")
    assert got == [(1, 1, 100.0), (2, 1, 70.0)]


def test_s10_group_by_name_vs_id(world):
    by_name = rows(sales.product_sales_window(world, AS_OF, 10), "ProductName", "TotalSales")
    assert by_name == [("Gadget", 90.0), ("Widget", 153.5)]
    by_id = rows(sales.product_ranking(world), "ProductID", "TotalSales")
    assert by_id == [(10, 106.0), (11, 47.5), (12, 90.0)]


def test_s5_trailing_window(world):
    got = rows(sales.product_sales_window(world, AS_OF, 1), "ProductName", "TotalSales")
    assert got == [("Gadget", 60.0), ("Widget", 106.0)]


def test_years_before_clamps_leap_day():
    assert A.years_before(dt.date(2004, 2, 29), 1) == dt.date(2003, 2, 28)


def test_s6_unique_order(world):
    df = sales.product_ranking(world)
    assert [r["ProductID"] for r in df.collect()] == [10, 12, 11]


def test_segments_two_billing_cities(world):
    got = rows(customers.customer_segments(world), "CustomerID", "City", "OrderCount", "TotalSpent")
    # customer 1 billed to two cities appears twice; order 103 has no address row and drops out
    assert got == [(1, "ALGERIA", 1, 100.0), (1, "ARGENTINA", 1, 50.0), (2, "BRAZIL", 1, 70.0)]


def test_retention_counts_all_orders(world):
    got = rows(customers.customer_retention(world), "CustomerID", "RepeatPurchaseCount", "LatestPurchaseDate")
    assert got == [(1, 2, dt.date(2001, 7, 1)), (2, 1, dt.date(2001, 8, 1)), (3, 1, dt.date(1999, 3, 3))]


def test_vendor_evaluation_by_vendor(world):
    got = rows(supply.vendor_evaluation_by_vendor(world), "VendorID", "PurchaseOrders", "AvgOrderCost",
               "AvgDeliveryDay")
    # vendor 1: orders 100 (-11 days), 101 (+4), 103 (-2): -9 div 3 = -3; cost (100+50+30)/3 = 60
    assert got == [(1, 3, 60.0, -3), (2, 1, 70.0, 3)]


# -- plans equal nested loops, also where dimension rows repeat --------------

KEYS = {"customer_segments": customers, "customer_retention": customers, "vendor_evaluation_by_vendor": supply, "inventory_anomalies": supply,
        "low_inventory_sellers": supply, "product_ranking": sales, "salesperson_performance": people}


@pytest.mark.parametrize("key", sorted(KEYS))
def test_repeated_dimension_rows_multiply(spark, world, key):
    # the same id with the same or another name: every row joins
    t = dict(world)
    t["part"] = world["part"].unionByName(world["part"].filter("p_partkey = 10")).unionByName(
        spark.createDataFrame([(12, "Gizmo", "b", "t", 1, 1.0)], world["part"].schema))
    t["supplier"] = world["supplier"].unionByName(world["supplier"].filter("s_suppkey = 1"))
    t["customer"] = world["customer"].unionByName(world["customer"].filter("c_custkey = 1"))
    columns, want = expected(key, t)
    assert want and sorted(map(tuple, getattr(KEYS[key], key)(t).select(*columns).collect())) == want


def test_empty_world_gives_empty_results(spark):
    t = make_tables(spark, nation=nations())
    assert sales.product_ranking(t).count() == 0
    assert supply.inventory_anomalies(t).count() == 0
