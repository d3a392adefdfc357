"""The data behind every chart of the reference report.

Second-level aggregates start from the exact (decimal) frames of the business
queries, so means and sums are exact before the final DOUBLE.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.functions.money import units_to_double
from salesengine.operators.bootstrap import bootstrap_ci
from salesengine.operators.distinct import rows_and_distinct
from salesengine.operators.histogram import histogram
from salesengine.operators.topk import bottom_k, top_k
from salesengine.plans import customers, sales
from salesengine.session import reliable_checkpoint

TEN_THOUSANDTHS = 10000.0


def chart_product_sales(t, as_of: dt.date | None = None, years: int = 10) -> DataFrame:
    """Bars of product name x TotalSales (B01 as is)."""
    return sales.product_sales_window(t, as_of, years)


def chart_year_mean_ci(t) -> DataFrame:
    """Per year, the mean monthly total and its 95 % bootstrap interval (seaborn barplot of B03)."""
    m = sales.monthly_sales_exact(t).select("Year", "Month", F.col("TotalSales").alias("x"))
    ci = bootstrap_ci(m, "Year", "Month", "x", scale=TEN_THOUSANDTHS)
    return ci.select("Year", F.col("Mean").alias("MeanMonthlySales"), F.col("N").alias("Months"), "CiLow",
                     "CiHigh").orderBy("Year")


def chart_monthly_line(t) -> DataFrame:
    """First-of-month date x TotalSales."""
    return sales.monthly_sales_exact(t).select(
        F.make_date("Year", "Month", F.lit(1)).alias("Date"), units_to_double("TotalSales").alias("TotalSales"),
    ).orderBy("Date")


def top10_products(t) -> DataFrame:
    """The 10 best-selling products of B04."""
    return top_k(sales.product_ranking(t), 10, [F.desc("TotalSales"), F.asc("ProductID")])


def bottom10_products(t) -> DataFrame:
    """The last 10 rows of B04 (pandas ``tail(10)``), in B04's order."""
    return bottom_k(sales.product_ranking(t), 10, [F.desc("TotalSales"), F.asc("ProductID")],
                    [F.asc("TotalSales"), F.desc("ProductID")])


def chart_segment_points(t) -> DataFrame:
    """The scatter points (OrderCount, TotalSpent, state) of every segment row; points need no order."""
    seg = customers.customer_segments_exact(t)
    return seg.select("CustomerID", "OrderCount", units_to_double("TotalSpent").alias("TotalSpent"), "StateProvinceID")


def state_avg_spent(t) -> DataFrame:
    """Mean TotalSpent over segment rows per state."""
    seg = customers.customer_segments_exact(t)
    return seg.groupBy("StateProvinceID").agg(
        (units_to_double(F.sum("TotalSpent")) / F.count("TotalSpent").cast("double")).alias("AvgTotalSpent"),
    ).orderBy("StateProvinceID")


def state_avg_orders(t) -> DataFrame:
    """Mean OrderCount over segment rows per state."""
    seg = customers.customer_segments_exact(t)
    return seg.groupBy("StateProvinceID").agg(
        (F.sum("OrderCount").cast("double") / F.count("OrderCount").cast("double")).alias("AvgOrderCount"),
    ).orderBy("StateProvinceID")


def state_row_count(t) -> DataFrame:
    """Segment rows per state (what the chart counts) and distinct customers (what its title says)."""
    seg = customers.customer_segments_exact(t)
    return rows_and_distinct(seg, ["StateProvinceID"], "CustomerID", "SegmentRows", "DistinctCustomers").orderBy("StateProvinceID")


def _city_counts(t) -> DataFrame:
    return customers.customer_segments_exact(t).groupBy("City").agg(F.count(F.lit(1)).alias("CustomerRows"))


def top20_cities(t) -> DataFrame:
    """The 20 most frequent cities among segment rows (ties by City)."""
    return top_k(_city_counts(t), 20, [F.desc("CustomerRows"), F.asc("City")])


def top20_city_counts(t) -> DataFrame:
    """C11: segment rows of the top-20 cities, counted per city: counting what is restricted equals restricting the counts."""
    return top20_cities(t)


def hist_repeat_purchases(t) -> DataFrame:
    """20 equal-width bins of RepeatPurchaseCount."""
    return histogram(customers.customer_retention_exact(t), "RepeatPurchaseCount", 20)


def hist_total_spent(t) -> DataFrame:
    """20 equal-width bins of TotalSpent."""
    return histogram(customers.customer_retention_exact(t), units_to_double("TotalSpent"), 20)


def hist_latest_purchase(t) -> DataFrame:
    """C14: 20 equal-width bins of LatestPurchaseDate, in days since 1970-01-01 (matplotlib's date axis)."""
    days = F.datediff("LatestPurchaseDate", F.lit("1970-01-01").cast("date"))
    return histogram(customers.customer_retention_exact(t), days, 20)


def top10_profit(t) -> DataFrame:
    """The 10 most profitable products of B12."""
    return top_k(sales.product_profitability(t), 10, [F.desc("Profit"), F.asc("ProductID")])


def territory_mean_ci(t) -> DataFrame:
    """Per territory, mean of B14's AvgSales with a 95 % bootstrap interval, labelled by B15."""
    # B14 and B15 share one territory x product aggregate, materialised once
    exact = reliable_checkpoint(sales.territory_product_sales_exact(t))
    rows = sales.territory_product_sales(t, exact).select(
        "TerritoryName", "BestSellingProduct",
        F.round(F.col("AvgSales") * F.lit(TEN_THOUSANDTHS)).cast("long").alias("x"))
    ci = bootstrap_ci(rows, "TerritoryName", "BestSellingProduct", "x", scale=TEN_THOUSANDTHS)
    label = sales.territory_best_product(t, exact).select("TerritoryName", F.col("BestSellingProduct").alias("Label"))
    return ci.select("TerritoryName", F.col("Mean").alias("MeanAvgSales"), "CiLow", "CiHigh").join(
        label, "TerritoryName", "left").orderBy(F.desc("MeanAvgSales"), "TerritoryName")
