"""The report runner writes every requested result and the CSV export."""

from salesengine.plans import tablejobs
from salesengine.report import run_report
from salesengine.session import storage_root
from tests.conftest import SF001


def test_report_writes_results(spark):
    out = f"{storage_root(spark)}/{tablejobs._run_name('report')}"
    written = run_report(spark, SF001, out, ["product_sales_window", "sales_by_month"])
    assert set(written) == {"product_sales_window", "sales_by_month"}
    assert spark.read.parquet(written["sales_by_month"]).count() > 0
    back = spark.read.option("header", True).csv(f"{written['product_sales_window']}_csv")
    assert back.columns == ["ProductName", "TotalSales"]
    assert back.count() == spark.read.parquet(written["product_sales_window"]).count()


def test_report_reuses_identical_results(spark):
    out = f"{storage_root(spark)}/{tablejobs._run_name('report')}"
    w = run_report(spark, SF001, out, ["customer_segments", "customer_demographics"])
    a = spark.read.parquet(w["customer_segments"])
    b = spark.read.parquet(w["customer_demographics"])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_shared_intermediates_are_built_once(spark):
    from salesengine.plans import sales
    from salesengine.sources.warehouse import load_tables

    t = load_tables(spark, SF001, share=True)
    a = sales.product_totals_exact(t)
    b = sales.product_totals_exact(t)
    assert a is b  # one checkpointed frame behind B04, B12, B13, C04, C05, C15
    plain = load_tables(spark, SF001)
    assert sales.product_totals_exact(plain) is not sales.product_totals_exact(plain)
