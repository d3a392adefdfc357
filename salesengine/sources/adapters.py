"""Warehouse tables of the reference, derived from the driver tables (FIXTURES.md §2).

Each adapter is a lazy DataFrame.  The order header comes in two forms:
``soh`` reads ``orders`` alone, ``soh_territory`` adds the customer join that
carries the territory, so queries that never use the territory do not pay for
a second fact-sized join.  Tables derived from ``lineitem`` (inventory,
product-vendor, purchase orders) aggregate before they join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.functions.money import discounted_fine, int_avg, line_total, money, money_units

# fixed values of the adapter mapping (FIXTURES.md §2)
BILL_TO_ADDRESSES = 25
SALESPERSON_COUNT = 10
NO_SALESPERSON_PRIORITY = "4-NOT SPECIFIED"
RETURNED_FLAG = "R"


def _ts(d: dt.date):
    """A date as a timestamp_ntz literal, comparable with the raw scan column (pushable)."""
    return F.lit(d.isoformat()).cast("date").cast("timestamp_ntz")


def soh(t, since: dt.date | None = None) -> DataFrame:
    """SalesOrderHeader without territory.  ``since`` filters the raw order date at the scan."""
    o = t["orders"]
    if since is not None:
        o = o.filter(F.col("o_orderdate") >= _ts(since))
    return o.select(
        F.col("o_orderkey").alias("SalesOrderID"),
        F.col("o_custkey").alias("CustomerID"),
        F.to_date("o_orderdate").alias("OrderDate"),
        money("o_totalprice").alias("TotalDue"),
        money_units("o_totalprice").alias("TotalDueU"),
        (F.col("o_orderkey") % BILL_TO_ADDRESSES).alias("BillToAddressID"),
        F.when(F.col("o_orderpriority") == NO_SALESPERSON_PRIORITY, F.lit(None))
        .otherwise(F.col("o_custkey") % SALESPERSON_COUNT).alias("SalesPersonID"),
    )


def soh_territory(t, since: dt.date | None = None) -> DataFrame:
    """SalesOrderHeader with TerritoryID (the billing customer's nation)."""
    c = t["customer"].select(F.col("c_custkey").alias("CustomerID"), F.col("c_nationkey").alias("TerritoryID"))
    return soh(t, since).join(c, "CustomerID")


def sod(t) -> DataFrame:
    """SalesOrderDetail: one row per order line; Gross = UnitPrice*OrderQty.

    ``GrossU`` (ten-thousandths) and ``LineTotalFine`` (10^-8) are the same amounts as exact long units.
    """
    gross = money_units("l_extendedprice")
    return t["lineitem"].select(
        F.col("l_orderkey").alias("SalesOrderID"),
        F.col("l_linenumber").alias("SalesOrderDetailID"),
        F.col("l_partkey").alias("ProductID"),
        money("l_extendedprice").alias("Gross"),
        line_total("l_extendedprice", "l_discount").alias("LineTotal"),
        gross.alias("GrossU"),
        discounted_fine(gross, "l_discount").alias("LineTotalFine"),
    )


def prod(t) -> DataFrame:
    return t["part"].select(F.col("p_partkey").alias("ProductID"), F.col("p_name").alias("Name"))


def cust(t) -> DataFrame:
    return t["customer"].select(F.col("c_custkey").alias("CustomerID"))


def addr(t) -> DataFrame:
    """Person.Address over ``nation``: a fixed 25-row table."""
    return t["nation"].select(
        F.col("n_nationkey").alias("AddressID"),
        F.col("n_name").alias("City"),
        F.col("n_regionkey").alias("StateProvinceID"),
    )


def terr(t) -> DataFrame:
    return t["nation"].select(F.col("n_nationkey").alias("TerritoryID"), F.col("n_name").alias("Name"))


def inv(t) -> DataFrame:
    """ProductInventory: one row per (product, location); Quantity = returned units."""
    return inv_and_sales(t).drop("SalesLines")


def inv_and_sales(t) -> DataFrame:
    """``inv`` and, from the same scan, how many order lines (``sod`` rows) lie behind each of its rows."""
    qty = F.when(F.col("l_returnflag") == RETURNED_FLAG, F.col("l_quantity")).otherwise(F.lit(0.0))
    return (
        t["lineitem"]
        .groupBy(F.col("l_partkey").alias("ProductID"), F.col("l_suppkey").alias("LocationID"))
        .agg(F.sum(qty).cast("int").alias("Quantity"), F.count("l_linenumber").alias("SalesLines"))
    )


def vend(t) -> DataFrame:
    return t["supplier"].select(F.col("s_suppkey").alias("BusinessEntityID"), F.col("s_name").alias("Name"))


def pv(t) -> DataFrame:
    """ProductVendor: per (product, vendor) the integer-average days from order to shipment."""
    li = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    o = t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return (
        li.join(o, "l_orderkey")
        .groupBy(F.col("l_suppkey").alias("BusinessEntityID"), F.col("l_partkey").alias("ProductID"))
        .agg(int_avg(days).alias("AverageLeadTime"))
    )


def product_vendors(t) -> DataFrame:
    """ProductVendor's keys: the (product, vendor) pairs with a line of an existing order; no lead times are worked out."""
    li = t["lineitem"].select("l_orderkey", F.col("l_suppkey").alias("BusinessEntityID"), F.col("l_partkey").alias("ProductID"))
    return li.join(t["orders"].select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select("BusinessEntityID", "ProductID").distinct()


def po(t) -> DataFrame:
    """PurchaseOrderHeader: each order with its first vendor and first ship date (NULL if no lines)."""
    first = t["lineitem"].groupBy(F.col("l_orderkey").alias("PurchaseOrderID")).agg(
        F.min("l_suppkey").alias("VendorID"), F.min("l_shipdate").alias("ship_ts"))
    o = t["orders"].select(
        F.col("o_orderkey").alias("PurchaseOrderID"),
        F.to_date("o_orderdate").alias("OrderDate"),
        money("o_totalprice").alias("TotalDue"),
        money_units("o_totalprice").alias("TotalDueU"),
    )
    return o.join(first, "PurchaseOrderID", "left").select(
        "PurchaseOrderID", "VendorID", "OrderDate", F.to_date("ship_ts").alias("ShipDate"), "TotalDue", "TotalDueU")


def person(t) -> DataFrame:
    n = t["nation"].select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("LastName"))
    return t["supplier"].join(n, "s_nationkey").select(
        F.col("s_suppkey").alias("BusinessEntityID"), F.col("s_name").alias("FirstName"), "LastName")


def emp(t) -> DataFrame:
    return t["supplier"].select(
        F.col("s_suppkey").alias("BusinessEntityID"),
        (F.floor("s_acctbal").cast("int") % 100).alias("VacationHours"),
        (F.col("s_suppkey") % 80).cast("int").alias("SickLeaveHours"),
    )


def edh(t) -> DataFrame:
    """EmployeeDepartmentHistory: every employee's department, plus a second one for every fourth."""
    s = t["supplier"]
    first = s.select(F.col("s_suppkey").alias("BusinessEntityID"), F.col("s_nationkey").alias("DepartmentID"))
    moved = s.filter(F.col("s_suppkey") % 4 == 0).select(
        F.col("s_suppkey").alias("BusinessEntityID"), ((F.col("s_nationkey") + 1) % 25).alias("DepartmentID"))
    return first.unionByName(moved)


def dept(t) -> DataFrame:
    return t["nation"].select(F.col("n_nationkey").alias("DepartmentID"), F.col("n_name").alias("Name"))


def feedback(t) -> DataFrame:
    """CustomerFeedback over ``events``."""
    return t["events"].select(
        F.col("event_id").alias("FeedbackID"),
        F.col("user_id").alias("CustomerID"),
        F.to_date("ts").alias("FeedbackDate"),
        F.col("props").alias("Comments"),
    )


ADAPTERS = {
    "soh": soh, "soh_territory": soh_territory, "sod": sod, "prod": prod, "cust": cust, "addr": addr,
    "terr": terr, "inv": inv, "vend": vend, "pv": pv, "po": po, "person": person, "emp": emp,
    "edh": edh, "dept": dept, "feedback": feedback,
}


def register_adapter_views(t) -> None:
    for name, fn in ADAPTERS.items():
        fn(t).createOrReplaceTempView(name)


# -- the "as of" date -------------------------------------------------------

def data_as_of(t) -> dt.date:
    """Latest order date in the data: one aggregate over a single column, returned as a scalar; a Tables object keeps it."""
    memo = getattr(t, "memo", {})
    if "as_of" not in memo:
        v = t["orders"].agg(F.max("o_orderdate").alias("m")).first()["m"]
        memo["as_of"] = v.date() if isinstance(v, dt.datetime) else v
    return memo["as_of"]


def years_before(d: dt.date, years: int) -> dt.date:
    """DATEADD(year, -n, d): same month and day, clamped to the month's end (Feb 29)."""
    y = d.year - years
    try:
        return d.replace(year=y)
    except ValueError:
        return d.replace(year=y, day=28)
