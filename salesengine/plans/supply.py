"""Inventory and vendor queries: B08-B11, B16.

B08 and B16 join a product to all its stock rows and all its sales rows; the
count over that fan-out equals (stock rows with that quantity) x (sales rows of
the product).  We compute both factors by aggregation and multiply, so no
many-to-many join is materialised and a product holding a third of all sales
is one row per map task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesengine.functions.money import int_avg_from, money_avg_units, units_sum
from salesengine.sources import adapters as A


def _sales_counts(t, since: dt.date) -> DataFrame:
    lines = A.sod(t).select("SalesOrderID", "ProductID", "SalesOrderDetailID")
    lines = lines.join(A.soh(t, since=since).select("SalesOrderID"), "SalesOrderID")
    return lines.groupBy("ProductID").agg(F.count("SalesOrderDetailID").alias("c"))


def _stock(t) -> DataFrame:
    """ProductID, Quantity, n stock rows of that quantity, c sales rows of the product, from one scan of the lines.

    The window sees one row per product and quantity.
    """
    per = A.inv_and_sales(t).groupBy("ProductID", "Quantity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("SalesLines").alias("lines"))
    return per.select("ProductID", "Quantity", "n", F.sum("lines").over(Window.partitionBy("ProductID")).alias("c"))


def _fan_out(stock: DataFrame, t) -> DataFrame:
    g = stock.join(A.prod(t), "ProductID").groupBy(
        "ProductID", F.col("Name").alias("ProductName"), F.col("Quantity").alias("InventoryQty"))
    return g.agg(F.sum(F.col("n") * F.coalesce(F.col("c"), F.lit(0))).alias("SalesCount"))


def inventory_anomalies(t, sales_since: dt.date | None = None) -> DataFrame:
    """(stock 0 and no sales) or stock > 100, per product x stock quantity.

    ``sales_since`` limits the left-joined sales to orders on or after a date
    (None = all sales, as written).
    """
    wanted = (F.col("Quantity") == 0) | (F.col("Quantity") > 100)  # implied by the HAVING clause
    if sales_since is None:
        stock = _stock(t).filter(wanted)
    else:
        stock = A.inv(t).filter(wanted).groupBy("ProductID", "Quantity").agg(F.count(F.lit(1)).alias("n"))
        stock = stock.join(_sales_counts(t, sales_since), "ProductID", "left")
    return _fan_out(stock, t).filter(
        ((F.col("InventoryQty") == 0) & (F.col("SalesCount") == 0)) | (F.col("InventoryQty") > 100)
    ).orderBy(F.asc("InventoryQty"), F.desc("SalesCount"), "ProductID")


def low_inventory_sellers(t) -> DataFrame:
    """Products with a stock row below 10 and their sales-row count; SalesCount desc."""
    return _fan_out(_stock(t).filter(F.col("Quantity") < 10), t).orderBy(
        F.desc("SalesCount"), "ProductID", "InventoryQty")


def vendor_lead_time(t) -> DataFrame:
    """Integer average of the vendor's per-product lead times; ascending."""
    per_vendor = A.pv(t).groupBy("BusinessEntityID").agg(
        F.sum("AverageLeadTime").alias("s"), F.count("AverageLeadTime").alias("n"))
    g = per_vendor.join(A.vend(t), "BusinessEntityID").groupBy(
        F.col("BusinessEntityID").alias("VendorID"), F.col("Name").alias("VendorName"),
    ).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return g.select("VendorID", "VendorName", int_avg_from("s", "n").alias("AvgLeadTimeDays")).orderBy(
        "AvgLeadTimeDays", "VendorID")


def _vendor_eval(orders: DataFrame, t) -> DataFrame:
    """Purchase-order measures per vendor; ``orders`` has VendorID and the purchase-order columns.

    Orders are reduced to one row per vendor (and map task) before the vendor
    join, so a vendor with a third of all orders is no hot join key.
    """
    days = F.datediff("ShipDate", "OrderDate")
    pre = orders.groupBy("VendorID").agg(
        F.count("PurchaseOrderID").alias("n_po"), units_sum("TotalDueU").alias("s_due"),
        F.count("TotalDueU").alias("n_due"),
        F.sum(days.cast("long")).alias("s_days"), F.count(days).alias("n_days"))
    v = A.vend(t).select(F.col("BusinessEntityID").alias("VendorID"), F.col("Name").alias("VendorName"))
    g = pre.join(v, "VendorID").groupBy("VendorID", "VendorName").agg(
        *[F.sum(c).alias(c) for c in ("n_po", "s_due", "n_due", "s_days", "n_days")])
    return g.select(
        "VendorID", "VendorName",
        F.col("n_po").alias("PurchaseOrders"),
        money_avg_units("s_due", "n_due").alias("AvgOrderCost"),
        int_avg_from("s_days", "n_days").alias("AvgDeliveryDay"),
    ).orderBy(F.desc("PurchaseOrders"), F.asc("AvgOrderCost"), F.asc("AvgDeliveryDay"), "VendorID")


def vendor_evaluation(t) -> DataFrame:
    """B10 as written: purchase orders matched on ProductID = PurchaseOrderID (two unrelated keys)."""
    pv = A.product_vendors(t).select(F.col("BusinessEntityID").alias("VendorID"), "ProductID")
    j = A.po(t).drop("VendorID").join(pv, F.col("ProductID") == F.col("PurchaseOrderID"))
    return _vendor_eval(j, t)


def vendor_evaluation_by_vendor(t) -> DataFrame:
    """B11 (corrected B10): each vendor's own purchase orders."""
    return _vendor_eval(A.po(t), t)
