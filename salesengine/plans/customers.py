"""Customer queries: B05-B07.

A join on CustomerID followed by a grouping on CustomerID cannot have a hot
customer split by AQE (that would need one more shuffle), so the orders are
aggregated *before* the customer join: with map-side partial aggregation a
customer holding a third of all orders reaches the join as a handful of rows.
The join with the customer table is then exact also when customer rows repeat
(their fan-out multiplies sums and counts as the literal join would).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.functions.money import units_sum, units_to_double
from salesengine.sources import adapters as A
from salesengine.sources.warehouse import shared


def customer_segments_exact(t) -> DataFrame:
    """Shared by several queries of one report run (``Tables.shared``)."""
    return shared(t, "segments", lambda: _customer_segments_exact_build(t))


def _customer_segments_exact_build(t) -> DataFrame:
    pre = A.soh(t).groupBy("CustomerID", "BillToAddressID").agg(
        F.count("SalesOrderID").alias("n"), units_sum("TotalDueU").alias("s"))
    j = (
        pre.join(A.cust(t), "CustomerID")
        .join(A.addr(t), F.col("BillToAddressID") == F.col("AddressID"))
    )
    return j.groupBy("CustomerID", "City", "StateProvinceID").agg(
        F.sum("n").alias("OrderCount"), F.sum("s").alias("TotalSpent"))


def customer_segments(t) -> DataFrame:
    """Per customer x billing city x state, order count and amount; TotalSpent desc."""
    return customer_segments_exact(t).select(
        "CustomerID", "City", "StateProvinceID", "OrderCount", units_to_double("TotalSpent").alias("TotalSpent"),
    ).orderBy(F.desc("TotalSpent"), "CustomerID", "City")


# B06 is word for word the SQL of B05.
customer_demographics = customer_segments


def customer_retention_exact(t) -> DataFrame:
    """Shared by several queries of one report run (``Tables.shared``)."""
    return shared(t, "retention", lambda: _customer_retention_exact_build(t))


def _customer_retention_exact_build(t) -> DataFrame:
    # the distinct count is planned as (customer, order) -> customer, so a hot
    # customer is spread over partitions by order id in the first stage
    pre = A.soh(t).groupBy("CustomerID").agg(
        F.count_distinct("SalesOrderID").alias("d"), units_sum("TotalDueU").alias("s"), F.max("OrderDate").alias("m"))
    # a repeated customer row repeats the same orders: distinct count unchanged, sum multiplied
    return pre.join(A.cust(t), "CustomerID").groupBy("CustomerID").agg(
        F.max("d").alias("RepeatPurchaseCount"), F.sum("s").alias("TotalSpent"), F.max("m").alias("LatestPurchaseDate"))


def customer_retention(t) -> DataFrame:
    """Per customer, distinct orders (all of them, first included), amount, latest order date."""
    return customer_retention_exact(t).select(
        "CustomerID", "RepeatPurchaseCount", units_to_double("TotalSpent").alias("TotalSpent"), "LatestPurchaseDate",
    ).orderBy(F.desc("RepeatPurchaseCount"), "CustomerID")
