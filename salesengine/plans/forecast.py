"""B17 sales forecast and C17 actual-plus-forecast chart data.

The reference fits one series (company monthly totals).  We forecast every
series in one job: the company total, one series per sales territory and one
per customer segment, all from one scan of the orders; ``product_forecast`` does
so for every product.
Months run from a series' first month to its last one.  The month of the latest
order may be incomplete; ``keep_partial_month=False`` leaves it out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.functions.money import fine_to_double, units_sum, units_to_double
from salesengine.operators.forecast import arima_111_forecast
from salesengine.sources import adapters as A
from salesengine.session import reliable_checkpoint

TOTAL_SERIES = "ALL"


def _month_start(d: dt.date) -> dt.date:
    return d.replace(day=1)


def monthly_series(t, as_of: dt.date | None = None, keep_partial_month: bool = True) -> DataFrame:
    """SeriesKey, Month (first day), TotalSales (DOUBLE from exact sums): total, territories, segments.

    ``as_of`` (by default the latest order) only matters with ``keep_partial_month=False``.
    """
    orders = A.soh(t)
    if not keep_partial_month:
        orders = orders.filter(F.col("OrderDate") < F.lit(_month_start(as_of or A.data_as_of(t))))
    month = F.trunc("OrderDate", "month").alias("Month")
    # one scan of orders: a left join keeps orders without a customer in the company total
    c = t["customer"].select(F.col("c_custkey").alias("CustomerID"), F.col("c_nationkey").alias("TerritoryID"),
                             F.col("c_mktsegment").alias("Segment"), F.lit(1).alias("hit"))
    per = (
        orders.join(c, "CustomerID", "left")
        .groupBy("TerritoryID", "Segment", month)
        .agg(units_sum("TotalDueU").alias("s"), F.count("hit").alias("matched"))
    )
    total = per.groupBy("Month").agg(F.sum("s").alias("s")).select(F.lit(TOTAL_SERIES).alias("SeriesKey"), "Month", "s")
    matched = per.filter(F.col("matched") > 0)
    terr = A.terr(t).withColumnRenamed("Name", "SeriesKey")
    by_terr = matched.groupBy("TerritoryID", "Month").agg(F.sum("s").alias("s")).join(terr, "TerritoryID").select(
        "SeriesKey", "Month", "s")
    by_seg = matched.filter(F.col("Segment").isNotNull()).groupBy(F.col("Segment").alias("SeriesKey"), "Month").agg(
        F.sum("s").alias("s"))
    return total.unionByName(by_terr).unionByName(by_seg).select(
        "SeriesKey", "Month", units_to_double("s").alias("TotalSales"))


def sales_forecast(t, as_of: dt.date | None = None, steps: int = 12, keep_partial_month: bool = True, method: str = "css") -> DataFrame:
    """SeriesKey, Step, ForecastDate, Forecast, Phi, Theta, Fit for every series."""
    m = monthly_series(t, as_of, keep_partial_month)
    return arima_111_forecast(m, "SeriesKey", "Month", "TotalSales", steps=steps, method=method).orderBy("SeriesKey", "Step")


def sales_forecast_exact(t, as_of: dt.date | None = None, steps: int = 12, keep_partial_month: bool = True) -> DataFrame:
    """B17 fitted by the exact likelihood, as the reference's library fits it."""
    return sales_forecast(t, as_of, steps, keep_partial_month, "exact")


def product_monthly_series(t, as_of: dt.date | None = None, keep_partial_month: bool = True) -> DataFrame:
    """SeriesKey (``Product <id>``, as names may repeat), Month, TotalSales (DOUBLE from exact sums of line totals) of every product sold.

    Order lines meet the orders for their month, and are reduced to (product, month) at once; no other join.
    """
    orders = A.soh(t)
    if not keep_partial_month:
        orders = orders.filter(F.col("OrderDate") < F.lit(_month_start(as_of or A.data_as_of(t))))
    month = F.trunc("OrderDate", "month").alias("Month")
    lines = A.sod(t).select("SalesOrderID", "ProductID", "LineTotalFine").filter(F.col("ProductID").isNotNull())
    per = lines.join(orders.select("SalesOrderID", "OrderDate"), "SalesOrderID").groupBy("ProductID", month).agg(units_sum("LineTotalFine").alias("s"))
    return per.select(F.concat(F.lit("Product "), F.col("ProductID").cast("string")).alias("SeriesKey"), "Month", fine_to_double("s").alias("TotalSales"))


def product_forecast(t, as_of: dt.date | None = None, steps: int = 12, keep_partial_month: bool = True, method: str = "css") -> DataFrame:
    """B17 for products: the columns of ``sales_forecast`` for every product's series."""
    m = product_monthly_series(t, as_of, keep_partial_month)
    return arima_111_forecast(m, "SeriesKey", "Month", "TotalSales", steps=steps, method=method).orderBy("SeriesKey", "Step")


def actual_and_forecast(t, as_of: dt.date | None = None, steps: int = 12, keep_partial_month: bool = True) -> DataFrame:
    """C17: the company series' monthly actuals followed by its forecast, with a Kind label."""
    m = reliable_checkpoint(monthly_series(t, as_of, keep_partial_month).filter(F.col("SeriesKey") == TOTAL_SERIES))
    actual = m.select(F.col("Month").alias("Date"), F.col("TotalSales").alias("Sales"), F.lit("actual").alias("Kind"))
    fc = arima_111_forecast(m, "SeriesKey", "Month", "TotalSales", steps=steps).select(
        F.col("ForecastDate").alias("Date"), F.col("Forecast").alias("Sales"), F.lit("forecast").alias("Kind"))
    return actual.unionByName(fc).orderBy("Date")
