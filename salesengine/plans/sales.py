"""Sales queries: B01-B04, B12-B15.

Fact rows are aggregated on the product / order key *before* they meet a
dimension, so a hot product or order collapses to one row per map task
(partial aggregation) instead of being shuffled and joined row by row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.functions.money import UNITS, fine_to_double, money_avg_units, units_sum, units_to_double
from salesengine.sources import adapters as A
from salesengine.sources.warehouse import shared


def window_start(t, as_of: dt.date | None, years: int) -> dt.date:
    """Start of the trailing window ``as_of - years``; ``as_of`` defaults to today (GETDATE())."""
    return A.years_before(as_of or dt.date.today(), years)


# -- B01 -------------------------------------------------------------------

def product_sales_window_exact(t, as_of: dt.date | None = None, years: int = 10) -> DataFrame:
    since = window_start(t, as_of, years)
    orders = A.soh(t, since=since).select("SalesOrderID")
    per_id = (
        A.sod(t).select("SalesOrderID", "ProductID", "LineTotalFine")
        .join(orders, "SalesOrderID")
        .groupBy("ProductID").agg(units_sum("LineTotalFine").alias("s"))
    )
    return (
        per_id.join(A.prod(t), "ProductID")
        .groupBy(F.col("Name").alias("ProductName")).agg(F.sum("s").alias("TotalSales"))
    )


def product_sales_window(t, as_of: dt.date | None = None, years: int = 10) -> DataFrame:
    """Total sales per product name for orders in the trailing window; TotalSales desc."""
    df = product_sales_window_exact(t, as_of, years)
    return df.select("ProductName", fine_to_double("TotalSales").alias("TotalSales")).orderBy(
        F.desc("TotalSales"), F.asc("ProductName"))


# -- B03 / B02 -------------------------------------------------------------

def monthly_sales_exact(t) -> DataFrame:
    """Shared by several queries of one report run (``Tables.shared``)."""
    return shared(t, "monthly", lambda: _monthly_sales_exact_build(t))


def _monthly_sales_exact_build(t) -> DataFrame:
    """Year, Month, TotalSales (exact units, decimal(38,0)) over all orders."""
    o = A.soh(t)
    return o.groupBy(
        F.year("OrderDate").cast("long").alias("Year"), F.month("OrderDate").cast("long").alias("Month"),
    ).agg(units_sum("TotalDueU").alias("TotalSales"))


def sales_by_month(t) -> DataFrame:
    """Year, Month, TotalSales ordered by Year, Month."""
    return monthly_sales_exact(t).select("Year", "Month", units_to_double("TotalSales").alias("TotalSales")).orderBy(
        "Year", "Month")


def sales_by_year(t, monthly: DataFrame | None = None) -> DataFrame:
    """B02 (corrected to the order header): Year, TotalSales; rolled up from the monthly totals."""
    m = monthly if monthly is not None else monthly_sales_exact(t)
    return m.groupBy("Year").agg(units_to_double(F.sum("TotalSales")).alias("TotalSales")).orderBy("Year")


# -- B04 -------------------------------------------------------------------

def product_totals_exact(t) -> DataFrame:
    """Shared by several queries of one report run (``Tables.shared``)."""
    return shared(t, "product_totals", lambda: _product_totals_exact_build(t))


def _product_totals_exact_build(t) -> DataFrame:
    """Per product id: exact sums of LineTotal (10^-8) and Gross (UnitPrice*OrderQty, ten-thousandths), joined to its name."""
    per_id = A.sod(t).groupBy("ProductID").agg(
        units_sum("LineTotalFine").alias("sales"), units_sum("GrossU").alias("cost"))
    return (
        per_id.join(A.prod(t), "ProductID")
        .groupBy("ProductID", F.col("Name").alias("ProductName"))
        .agg(F.sum("sales").alias("sales"), F.sum("cost").alias("cost"))
    )


def product_ranking(t) -> DataFrame:
    """ProductID, ProductName, TotalSales per product id; TotalSales desc."""
    return product_totals_exact(t).select(
        "ProductID", "ProductName", fine_to_double("sales").alias("TotalSales"),
    ).orderBy(F.desc("TotalSales"), "ProductID")


# -- B12 / B13 -------------------------------------------------------------

def _profit_columns(df: DataFrame) -> dict:
    return {
        "TotalSales": fine_to_double("sales").alias("TotalSales"),
        "TotalCost": units_to_double("cost").alias("TotalCost"),
        "Profit": fine_to_double(F.col("sales") - F.col("cost") * F.lit(UNITS)).alias("Profit"),
    }


def product_profitability(t) -> DataFrame:
    """TotalSales, TotalCost = sum(UnitPrice*OrderQty), Profit = difference; Profit desc.

    As written, "cost" is the undiscounted revenue, so Profit = -discount <= 0.
    """
    df = product_totals_exact(t)
    c = _profit_columns(df)
    return df.select("ProductID", "ProductName", c["TotalSales"], c["TotalCost"], c["Profit"]).orderBy(
        F.desc("Profit"), "ProductID")


def cost_structure(t) -> DataFrame:
    """Same measures as B12, TotalCost desc."""
    df = product_totals_exact(t)
    c = _profit_columns(df)
    return df.select("ProductID", "ProductName", c["TotalCost"], c["TotalSales"], c["Profit"]).orderBy(
        F.desc("TotalCost"), "ProductID")


# -- B14 / B15 -------------------------------------------------------------

def _territory_product_lines(t) -> DataFrame:
    """Order lines with their order's territory and amount (header amount repeated per line, S9)."""
    lines = A.sod(t).select("SalesOrderID", "ProductID", "LineTotalFine")
    orders = A.soh_territory(t).select("SalesOrderID", "TerritoryID", "TotalDueU")
    return lines.join(orders, "SalesOrderID")


def territory_product_sales_exact(t) -> DataFrame:
    """Shared by several queries of one report run (``Tables.shared``)."""
    return shared(t, "territory_product", lambda: _territory_product_sales_exact_build(t))


def _territory_product_sales_exact_build(t) -> DataFrame:
    pre = _territory_product_lines(t).groupBy("TerritoryID", "ProductID").agg(
        units_sum("TotalDueU").alias("s"), F.count("TotalDueU").alias("n"), F.max("TotalDueU").alias("m"),
        units_sum("LineTotalFine").alias("line_sales"))
    named = (
        pre.join(A.terr(t).withColumnRenamed("Name", "TerritoryName"), "TerritoryID")
        .join(A.prod(t).withColumnRenamed("Name", "ProductName"), "ProductID")
    )
    return named.groupBy("TerritoryName", "ProductName").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("m").alias("m"),
        F.sum("line_sales").alias("line_sales"))


def territory_product_sales(t, exact: DataFrame | None = None) -> DataFrame:
    """B14 as written: per territory x product name, AvgSales/MaxSale of the order amount; AvgSales desc."""
    df = exact if exact is not None else territory_product_sales_exact(t)
    return df.select(
        "TerritoryName",
        money_avg_units("s", "n").alias("AvgSales"),
        F.col("ProductName").alias("BestSellingProduct"),
        units_to_double("m").alias("MaxSale"),
    ).orderBy(F.desc("AvgSales"), "TerritoryName", "BestSellingProduct")


def territory_best_product(t, exact: DataFrame | None = None) -> DataFrame:
    """B15 (corrected B14): the one best-selling product (by line sales) of each territory.

    Top-1 per group as an aggregate (``min_by`` over (-sales, name)), so it is
    computed partially on the map side and never sorts a whole group.
    """
    df = exact if exact is not None else territory_product_sales_exact(t)
    best = df.groupBy("TerritoryName").agg(
        F.min_by(F.struct(F.col("ProductName"), F.col("line_sales")),
                 F.struct((-F.col("line_sales")).alias("k"), F.col("ProductName"))).alias("b"))
    return best.select(
        "TerritoryName",
        F.col("b.ProductName").alias("BestSellingProduct"),
        fine_to_double("b.line_sales").alias("ProductSales"),
    ).orderBy(F.desc("ProductSales"), "TerritoryName")
