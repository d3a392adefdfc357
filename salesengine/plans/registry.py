"""The query catalogue: key -> Spark job and key -> DuckDB oracle SQL.

reads the whole driver tables and returns a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from salesengine.plans import charts, customers, forecast, oracle, people, sales, supply, tablejobs
from salesengine.sources import adapters as A
from salesengine.sources.bucketed import BucketedTables, write_bucketed
from salesengine.sources.warehouse import load_tables

Query = Callable[[SparkSession, str], DataFrame]

# the checked window: one year back from the latest order in the data (FIXTURES.md §2)
WINDOW_YEARS = 1


def _query(on_tables, fn) -> Query:
    """A (spark, sf_dir) callable; ``.on_tables(spark, t)`` runs it on an existing Tables object."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return on_tables(spark, load_tables(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    run.on_tables = on_tables
    return run


def _t(fn):
    return _query(lambda spark, t: fn(t), fn)


def _windowed(fn):
    return _query(lambda spark, t: fn(t, A.data_as_of(t), WINDOW_YEARS), fn)


def _job(fn):
    return _query(fn, fn)


def _bucketed(fn):
    """The query over orders and lines that a load job has stored by order key first."""
    def on_tables(spark, t):
        b = BucketedTables(spark, t.root, write_bucketed(t))
        return fn(b, A.data_as_of(b), WINDOW_YEARS)
    return _query(on_tables, fn)


def _inventory_recent(t):
    return supply.inventory_anomalies(t, sales_since=A.years_before(A.data_as_of(t), WINDOW_YEARS))


QUERIES: dict[str, Query] = {
    "product_sales_window": _windowed(sales.product_sales_window),
    "product_sales_window_bucketed": _bucketed(sales.product_sales_window),
    "sales_by_year": _t(sales.sales_by_year),
    "sales_by_month": _t(sales.sales_by_month),
    "product_ranking": _t(sales.product_ranking),
    "customer_segments": _t(customers.customer_segments),
    "customer_demographics": _t(customers.customer_demographics),
    "customer_retention": _t(customers.customer_retention),
    "inventory_anomalies": _t(supply.inventory_anomalies),
    "inventory_anomalies_recent": _t(_inventory_recent),
    "vendor_lead_time": _t(supply.vendor_lead_time),
    "vendor_evaluation": _t(supply.vendor_evaluation),
    "vendor_evaluation_by_vendor": _t(supply.vendor_evaluation_by_vendor),
    "product_profitability": _t(sales.product_profitability),
    "cost_structure": _t(sales.cost_structure),
    "territory_product_sales": _t(sales.territory_product_sales),
    "territory_best_product": _t(sales.territory_best_product),
    "low_inventory_sellers": _t(supply.low_inventory_sellers),
    "salesperson_performance": _t(people.salesperson_performance),
    "department_productivity": _t(people.department_productivity),
    "chart_product_sales": _windowed(charts.chart_product_sales),
    "chart_year_mean_ci": _t(charts.chart_year_mean_ci),
    "chart_monthly_line": _t(charts.chart_monthly_line),
    "top10_products": _t(charts.top10_products),
    "bottom10_products": _t(charts.bottom10_products),
    "chart_segment_points": _t(charts.chart_segment_points),
    "state_avg_spent": _t(charts.state_avg_spent),
    "state_avg_orders": _t(charts.state_avg_orders),
    "state_row_count": _t(charts.state_row_count),
    "top20_cities": _t(charts.top20_cities),
    "top20_city_counts": _t(charts.top20_city_counts),
    "hist_repeat_purchases": _t(charts.hist_repeat_purchases),
    "hist_total_spent": _t(charts.hist_total_spent),
    "hist_latest_purchase": _t(charts.hist_latest_purchase),
    "top10_profit": _t(charts.top10_profit),
    "territory_mean_ci": _t(charts.territory_mean_ci),
    "sales_forecast": _t(forecast.sales_forecast),
    "sales_forecast_exact": _t(forecast.sales_forecast_exact),
    "product_forecast": _t(forecast.product_forecast),
    "actual_and_forecast": _t(forecast.actual_and_forecast),
    "src_table_query": _job(tablejobs.src_table_query),
    "csv_read": _job(tablejobs.csv_read),
    "csv_read_inferred": _job(tablejobs.csv_read_inferred),
    "csv_export": _job(tablejobs.csv_export),
    "identity_assign": _job(tablejobs.identity_assign),
    "table_append": _job(tablejobs.table_append),
    "table_replace": _job(tablejobs.table_replace),
    "table_insert_values": _job(tablejobs.table_insert_values),
    "table_update": _job(tablejobs.table_update),
    "table_delete": _job(tablejobs.table_delete),
    "reviews_load": _job(tablejobs.reviews_load),
    "reviews_load_wide": _job(tablejobs.reviews_load_wide),
    "feedback_lifecycle": _job(tablejobs.feedback_lifecycle),
    "preview": _job(tablejobs.preview),
}

ORACLE: dict[str, str] = {
    "product_sales_window": oracle.B01,
    "product_sales_window_bucketed": oracle.B01,
    "sales_by_year": oracle.B02,
    "sales_by_month": oracle.B03,
    "product_ranking": oracle.B04,
    "customer_segments": oracle.B05,
    "customer_demographics": oracle.B05,
    "customer_retention": oracle.B07,
    "inventory_anomalies": oracle.B08,
    "inventory_anomalies_recent": oracle.B08_RECENT,
    "vendor_lead_time": oracle.B09,
    "vendor_evaluation": oracle.B10,
    "vendor_evaluation_by_vendor": oracle.B11,
    "product_profitability": oracle.B12,
    "cost_structure": oracle.B13,
    "territory_product_sales": oracle.B14,
    "territory_best_product": oracle.B15,
    "low_inventory_sellers": oracle.B16,
    "salesperson_performance": oracle.B18,
    "department_productivity": oracle.B19,
    "chart_product_sales": oracle.C01,
    "chart_year_mean_ci": oracle.C02,
    "chart_monthly_line": oracle.C03,
    "top10_products": oracle.C04,
    "bottom10_products": oracle.C05,
    "chart_segment_points": oracle.C06,
    "state_avg_spent": oracle.C07,
    "state_avg_orders": oracle.C08,
    "state_row_count": oracle.C09,
    "top20_cities": oracle.C10,
    "top20_city_counts": oracle.C11,
    "hist_repeat_purchases": oracle.C12,
    "hist_total_spent": oracle.C13,
    "hist_latest_purchase": oracle.C14,
    "top10_profit": oracle.C15,
    "territory_mean_ci": oracle.C16,
    "sales_forecast": oracle.B17,
    "sales_forecast_exact": oracle.B17_EXACT,
    "product_forecast": oracle.B17_PRODUCTS,
    "actual_and_forecast": oracle.C17,
    "src_table_query": oracle.B03,
    "csv_read": oracle.A04,
    "csv_read_inferred": oracle.A04_INFERRED,
    "csv_export": oracle.B01,
    "identity_assign": oracle.A08,
    "table_append": oracle.A09,
    "table_replace": oracle.A10,
    "table_insert_values": oracle.A11,
    "table_update": oracle.A12,
    "table_delete": oracle.A13,
    "reviews_load": oracle.A14,
    "reviews_load_wide": oracle.A14_WIDE,
    "feedback_lifecycle": oracle.A15,
    "preview": oracle.A16,
}
