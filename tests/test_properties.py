"""Property tests against independent implementations (numpy, Python decimals)."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salesengine.functions.money import int_avg, money_avg, money_avg_units, units_sum
from salesengine.operators.histogram import histogram

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(st.integers(-1000, 1000), min_size=1, max_size=60))
def test_histogram_equals_numpy(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r["Count"] for r in histogram(df, "x", 20).collect()]
    want, _ = np.histogram(np.array(xs, dtype=float), bins=20)
    assert got == list(want)


@SETTINGS
@given(st.lists(st.integers(-10 ** 6, 10 ** 6), min_size=1, max_size=40))
def test_int_avg_truncates_like_python(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    got = df.agg(int_avg("x").alias("a")).first()["a"]
    s, n = sum(xs), len(xs)
    assert got == (abs(s) // n) * (1 if s >= 0 else -1)


@SETTINGS
@given(st.lists(st.integers(-10 ** 8, 10 ** 8), min_size=1, max_size=40))
def test_money_avg_rounds_half_away_from_zero(spark, cents):
    df = spark.createDataFrame([(c / 100.0,) for c in cents], "x double")
    got = df.agg(money_avg("x").alias("a")).first()["a"]
    exact = Decimal(sum(cents)) / Decimal(100) / Decimal(len(cents))
    q = abs(exact).quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP) * (1 if exact >= 0 else -1)
    assert got == float(q)


@SETTINGS
@given(st.lists(st.integers(-(2 ** 40), 2 ** 40), min_size=1, max_size=40))
def test_split_units_sum_is_exact(spark, us):
    df = spark.createDataFrame([(u,) for u in us], "u long")
    r = df.agg(units_sum("u").alias("s"), money_avg_units(units_sum("u"), F.count("u")).alias("a")).first()
    assert int(r["s"]) == sum(us)
    exact = Decimal(sum(us)) / Decimal(len(us))
    q = abs(exact).quantize(Decimal("1"), rounding=ROUND_HALF_UP) * (1 if exact >= 0 else -1)
    assert r["a"] == float(q) / 10000.0


def test_money_keeps_four_decimals(spark):
    """Prices and discounts of four decimals against exact decimals."""
    from salesengine.functions.money import discounted_fine, fine_to_double, money_units

    amounts = ["1.2345", "21141.8929", "-0.0001", "99999999.9999", "0.3", "1234.5"]
    df = spark.createDataFrame([(float(a),) for a in amounts], "x double")
    assert [r[0] for r in df.select(money_units("x")).collect()] == [int(Decimal(a) * 10000) for a in amounts]
    lines = [("200.0", "0.1255"), ("0.2", "0.0005"), ("1234.56", "0.07"), ("21141.8929", "0.0"), ("10.123", "0.05"), ("-3.3333", "0.3333"), ("90000000000", "0.0001")]
    frame = spark.createDataFrame([(float(p), float(d)) for p, d in lines] + [(None, 0.1), (1.0, None)], "p double, d double")
    exact = [Decimal(p) * (1 - Decimal(d)) for p, d in lines]
    fine = discounted_fine(money_units("p"), "d")
    assert [r[0] for r in frame.select(fine).collect()] == [int(x * 10**8) for x in exact] + [None, None]
    total = frame.where("p < 1e6").select(fine.alias("u")).agg(fine_to_double(units_sum("u"))).first()[0]
    assert total == float(sum(x for x, (p, _) in zip(exact, lines, strict=True) if float(p) < 1e6))


def test_totals_of_prices_with_four_decimals(spark):
    """B01's, B04's and B12's sums over such lines equal exact decimals; nothing raises."""
    from tests.fixtures import make_tables

    from salesengine.plans import sales

    prices = [("10.1230", "0.0500"), ("0.0001", "0.3333"), ("99.9999", "0.1111"), ("5.5555", "0.0000")]
    t = make_tables(spark, part=[(1, "p", "b", "t", 1, 1.0)],
                    lineitem=[(k, 1, 1, 1, 1.0, float(p), float(d), 0.0, "N", "O", None) for k, (p, d) in enumerate(prices)])
    sales_exact = sum(Decimal(p) * (1 - Decimal(d)) for p, d in prices)
    cost = sum(Decimal(p) for p, _ in prices)
    row = sales.product_profitability(t).first()
    assert (row["TotalSales"], row["TotalCost"], row["Profit"]) == (float(sales_exact), float(cost), float(sales_exact - cost))
    assert sales.product_ranking(t).first()["TotalSales"] == float(sales_exact)
