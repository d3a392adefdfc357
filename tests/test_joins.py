"""Joins of orders and lines: without a shuffle on bucketed storage, thinned by a Bloom filter on plain files; bitmaps instead of distinct."""

import pytest
from pyspark.sql import functions as F

from salesengine.operators.distinct import bitmaps, merged, rows_and_distinct
from salesengine.plans import charts, forecast, registry, sales, supply
from salesengine.sources import adapters as A
from salesengine.sources.bucketed import KEYS, BucketedTables, write_bucketed
from salesengine.sources.warehouse import load_tables
from tests.conftest import SF001, SF01


def tree(df) -> list[tuple[int, str]]:
    out = []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        name = line.lstrip(" :+-*()0123456789")
        out.append((len(line) - len(line.lstrip(" :+-")), name))
    return out


def below(nodes: list[tuple[int, str]], i: int) -> list[str]:
    out = []
    for depth, name in nodes[i + 1:]:
        if depth <= nodes[i][0]:
            break
        out.append(name)
    return out


@pytest.fixture(scope="module")
def bucketed(spark):
    return BucketedTables(spark, SF001, write_bucketed(load_tables(spark, SF001), buckets=8))


@pytest.fixture()
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k in keys:
        spark.conf.unset(k)


QUERIES = {
    "B01": lambda t: sales.product_sales_window(t, A.data_as_of(t), 1),
    "B09": supply.vendor_lead_time,
    "B14": sales.territory_product_sales,
    "product_forecast": forecast.product_forecast,
}


@pytest.mark.parametrize("key", ["B01", "B09", "product_forecast"])
def test_fact_join_needs_no_exchange(spark, bucketed, no_broadcast, key):
    nodes = tree(QUERIES[key](bucketed))
    joins = [i for i, (_, n) in enumerate(nodes) if n.startswith("SortMergeJoin") and ("OrderID" in n or "orderkey" in n)]
    assert joins, nodes
    for i in joins:
        under = below(nodes, i)
        assert not [n for n in under if n.startswith("Exchange")], under
    plain = tree(QUERIES[key](load_tables(spark, SF001)))
    assert sum(n.startswith("Exchange") for _, n in nodes) <= sum(n.startswith("Exchange") for _, n in plain) - 2


def test_files_in_order_need_no_sort(spark, bucketed, no_broadcast):
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    try:
        df = QUERIES["B01"](bucketed)
        nodes = tree(df)
        join = next(i for i, (_, n) in enumerate(nodes) if n.startswith("SortMergeJoin") and "OrderID" in n)
        assert not [n for n in below(nodes, join) if n.startswith(("Exchange", "Sort "))]
        assert df.collect() == QUERIES["B01"](load_tables(spark, SF001)).collect()
    finally:
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")


def test_lines_are_not_shuffled_for_the_territory_join(spark, bucketed, no_broadcast):
    nodes = tree(QUERIES["B14"](bucketed))
    join = next(i for i, (_, n) in enumerate(nodes) if n.startswith("SortMergeJoin") and "SalesOrderID" in n)
    side = below(nodes, join)
    lines = next(i for i, n in enumerate(side) if n.startswith(("FileScan", "Scan")) and "l_orderkey" in n)
    before = [n for n in side[:lines] if n.startswith("Exchange")]
    assert not before, side


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_same_rows_from_buckets(spark, bucketed, key):
    a, b = (QUERIES[key](t).collect() for t in (bucketed, load_tables(spark, SF001)))
    assert a == b


def test_buckets_hold_every_row_once(spark, bucketed):
    plain = load_tables(spark, SF001)
    for name in KEYS:
        assert bucketed[name].exceptAll(plain[name]).count() == 0 and bucketed[name].count() == plain[name].count()


def test_window_thins_the_lines_by_a_bloom_filter(spark, no_broadcast):
    keys = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
            "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"}
    t = load_tables(spark, SF01)
    want = QUERIES["B01"](t).collect()
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        df = QUERIES["B01"](load_tables(spark, SF01))
        assert "might_contain" in df._jdf.queryExecution().optimizedPlan().toString()
        assert df.collect() == want
        lines, orders = t["lineitem"], t["orders"].where(F.col("o_orderdate") >= A._ts(sales.window_start(t, A.data_as_of(t), 1)))
        share = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").count() / lines.count()
        kept = _rows_into_line_exchange(spark, df) / lines.count()
        assert kept <= share * 1.2 + 0.01 < 0.5
    finally:
        for k in keys:
            spark.conf.unset(k)


def _rows_into_line_exchange(spark, df) -> int:
    """Rows written by the shuffle of the lines, from the executed plan's metrics."""
    df.collect()
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name == "Exchange" and "l_orderkey" in node.toString() or name == "Exchange" and "SalesOrderID" in node.simpleString(1000) and "ProductID" in node.output().toString():
            found.append(node.metrics().get("shuffleRecordsWritten").get().value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return min(x for x in found if x)


def test_bitmaps_equal_distinct(spark):
    rows = [(i % 3, i % 7, k) for i, k in enumerate([0, 1, 1, -1, -5, 32768, 32769, 10**12, 10**12, None, 5, 65536, 65536, -40000])]
    df = spark.createDataFrame(rows, "g int, m int, k long")
    got = sorted(map(tuple, rows_and_distinct(df, ["g"], "k", "n", "d").collect()))
    assert got == sorted(map(tuple, df.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("k").alias("d")).collect()))
    by_month = merged(bitmaps(df, ["g", "m"], "k"), ["g"]).groupBy("g").agg(F.sum("rows"), F.sum(F.bitmap_count("bits")))
    assert sorted(map(tuple, by_month.collect())) == got
    text = df.select("g", F.col("k").cast("string").alias("k"))
    assert sorted(map(tuple, rows_and_distinct(text, ["g"], "k", "n", "d").collect())) == got


def test_state_counts_have_no_distinct_expansion(spark):
    plan = charts.state_row_count(load_tables(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and "count(distinct" not in plan
    assert registry.QUERIES["state_row_count"](spark, SF001).count() > 0
