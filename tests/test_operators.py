"""Properties of the operators: histogram, top/bottom-k, identity, bootstrap, forecast."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesengine.operators import bootstrap as boot
from salesengine.operators import forecast as arima
from salesengine.operators.bootstrap import bootstrap_ci
from salesengine.operators.forecast import arima_111_forecast
from salesengine.operators.histogram import histogram
from salesengine.operators.identity import assign_identity
from salesengine.operators.topk import bottom_k, top_k


def test_histogram_bins_cover_input(spark):
    df = spark.range(0, 101).select(F.col("id").cast("double").alias("x"))
    h = histogram(df, "x", 20).collect()
    assert [r["Bin"] for r in h] == list(range(20))
    assert sum(r["Count"] for r in h) == 101
    assert h[-1]["Count"] == 6  # the maximum falls in the closed last bin (95..100)
    assert h[0]["BinStart"] == 0.0 and h[-1]["BinEnd"] == 100.0


def test_histogram_constant_and_empty_bins(spark):
    h = histogram(spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double"), "x", 20).collect()
    assert len(h) == 20 and h[10]["Count"] == 2 and sum(r["Count"] for r in h) == 2
    h = histogram(spark.createDataFrame([(0.0,), (10.0,)], "x double"), "x", 20).collect()
    assert [r["Count"] for r in h] == [1] + [0] * 18 + [1]


def test_top_and_bottom_k(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(30)], "id long, v double")
    order = [F.desc("v"), F.asc("id")]
    top = [r["id"] for r in top_k(df, 3, order).collect()]
    assert top == [4, 9, 14]
    full = [r["id"] for r in df.orderBy(*order).collect()]
    bottom = [r["id"] for r in bottom_k(df, 4, order, [F.asc("v"), F.desc("id")]).collect()]
    assert bottom == full[-4:]


def test_top_k_plans_take_ordered(spark, capsys):
    df = spark.range(1000)
    top_k(df, 10, [F.desc("id")]).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out


def test_identity_is_consecutive_across_partitions(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("s"))
    out = assign_identity(df, ["k"], "ID", start=11)
    got = sorted((r["k"], r["ID"]) for r in out.collect())
    assert [i for _, i in got] == list(range(11, 5011))  # ordered by k, no gaps


def _mixed(h):
    """Murmur3's finish in plain integers."""
    m = 0xFFFFFFFF
    h ^= h >> 16
    h = h * 0x85EBCA6B & m
    h ^= h >> 13
    h = h * 0xC2B2AE35 & m
    return h ^ (h >> 16)


def _slow_bootstrap(group, values, replicates):
    """Mean and interval by drawing row numbers one by one."""
    m, n = 0xFFFFFFFF, len(values)
    seed = int(hashlib.md5(str(group).encode()).hexdigest()[:8], 16)
    means = []
    for b in range(replicates):
        of = _mixed((seed + b * boot._PER_REPLICATE) & m)
        means.append(sum(values[_mixed((of + j * boot._PER_DRAW) & m) * n >> 32] for j in range(n)) / n)
    means.sort()
    return sum(values) / n, means[(replicates - 1) * 25 // 1000], means[(replicates - 1) * 975 // 1000]


def test_bootstrap_draws_equal_brute_force(spark):
    r = random.Random(3)
    groups = {g: [r.randrange(-50, 10**6) for _ in range(n)] for g, n in [(1, 1), (2, 12), (3, 300)]}
    df = spark.createDataFrame([(g, i, x) for g, xs in groups.items() for i, x in enumerate(xs)], "g long, r long, x long").repartition(5)
    for row in bootstrap_ci(df, "g", "r", "x", replicates=301).collect():
        mean, low, high = _slow_bootstrap(row["g"], groups[row["g"]], 301)
        assert (row["N"], row["Mean"], row["CiLow"], row["CiHigh"]) == (len(groups[row["g"]]), mean, low, high)


def test_bootstrap_of_many_chunks_draws_every_row_alike(spark):
    """A group cut into chunks: each replicate still draws n of n rows, and the interval is that of one chunk."""
    xs = [(i * 7919) % 1000 for i in range(4000)]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(xs)], "g string, r long, x long").repartition(4)
    one, cut = (bootstrap_ci(df, "g", "r", "x", replicates=401, chunk_rows=c).first() for c in (1 << 16, 300))
    assert (one["N"], one["Mean"]) == (cut["N"], cut["Mean"])
    spread = one["CiHigh"] - one["CiLow"]
    expected = 2 * 1.96 * np.std(xs) / math.sqrt(len(xs))
    for ci in (one, cut):
        assert abs((ci["CiHigh"] - ci["CiLow"]) / expected - 1) < 0.15 and abs(ci["CiLow"] - one["CiLow"]) < 0.15 * spread
    ones = df.withColumn("x", F.lit(1))
    row = bootstrap_ci(ones, "g", "r", "x", replicates=51, chunk_rows=300).first()
    assert (row["Mean"], row["CiLow"], row["CiHigh"]) == (1.0, 1.0, 1.0)  # exactly n draws in every replicate


def test_draws_are_uniform():
    at = boot.draws(12345, np.arange(200), 0, 1000, 1000)
    counts = np.bincount(at.ravel(), minlength=1000)
    assert at.min() >= 0 and at.max() < 1000 and abs(((counts - 200) ** 2 / 200).sum() - 999) < 6 * math.sqrt(2 * 999)
    weights = np.bincount(np.bincount(at[0], minlength=1000), minlength=3) / 1000
    assert abs(weights[0] - math.exp(-1)) < 0.06 and abs(weights[1] - math.exp(-1)) < 0.06


def test_bootstrap_interval_brackets_mean(spark):
    rows = [("g", i, 100 + (i * 37) % 23) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, r long, x long")
    ci = bootstrap_ci(df, "g", "r", "x", replicates=201).first()
    mean = sum(r[2] for r in rows) / len(rows)
    assert ci["CiLow"] < mean < ci["CiHigh"]
    again = bootstrap_ci(df, "g", "r", "x", replicates=201).first()
    assert (ci["CiLow"], ci["CiHigh"]) == (again["CiLow"], again["CiHigh"])  # reproducible


def test_bootstrap_of_values_beyond_a_long(spark):
    """Amounts of 10^21 and more: the interval is that of the same values in larger units."""
    xs = [(i % 7, 100 + (i * 37) % 23 - (i % 2) * 150) for i in range(40)]
    small = spark.createDataFrame([("g", i, x) for i, (_, x) in enumerate(xs)], "g string, r long, x long")
    big = small.withColumn("x", F.col("x") * F.lit("1e19").cast("decimal(20,0)"))
    a, b = bootstrap_ci(small, "g", "r", "x", replicates=101).first(), bootstrap_ci(big, "g", "r", "x", replicates=101).first()
    assert b["N"] == 40 and abs(a["Mean"] - sum(x for _, x in xs) / 40) < 1e-12
    for c in ("Mean", "CiLow", "CiHigh"):
        assert abs(b[c] / 1e19 - a[c]) < 1e-9 * max(1, abs(a[c]))


def test_bootstrap_mean_skips_nulls(spark):
    df = spark.createDataFrame([("g", 1, 10), ("g", 2, None), ("g", 3, 20)], "g string, r long, x long")
    ci = bootstrap_ci(df, "g", "r", "x", replicates=21).first()
    assert (ci["Mean"], ci["N"]) == (15.0, 2)


def test_missing_months_are_zero(spark):
    got = arima.dense(np.array([24241, 24244, 24245]), np.array([1.0, np.nan, 2.5]))
    assert got.tolist() == [1.0, 0.0, 0.0, 0.0, 2.5]
    rows = [("s", dt.date(2020, m, 1), v) for m, v in [(1, 5.0), (4, 7.0), (6, None), (7, 3.0), (8, 9.0)]]
    full = [("s", dt.date(2020, m, 1), {1: 5.0, 4: 7.0, 7: 3.0, 8: 9.0}.get(m, 0.0)) for m in range(1, 9)]
    a, b = (arima_111_forecast(spark.createDataFrame(x, "k string, m date, v double"), "k", "m", "v").collect() for x in (rows, full))
    assert sorted(a) == sorted(b)


def test_forecast_differences_decay_by_phi(spark):
    ys = [100.0, 130.0, 90.0, 150.0, 120.0, 170.0, 110.0, 160.0, 140.0, 180.0, 120.0, 175.0]
    rows = [("s", dt.date(2020 + i // 12, i % 12 + 1, 1), y) for i, y in enumerate(ys)]
    m = spark.createDataFrame(rows, "k string, m date, v double")
    fc = sorted((r["Step"], r["Forecast"], r["Phi"], r["ForecastDate"]) for r in
                arima_111_forecast(m, "k", "m", "v", steps=12).collect())
    assert [s for s, *_ in fc] == list(range(1, 13))
    assert fc[0][3] == dt.date(2021, 1, 1) and fc[-1][3] == dt.date(2021, 12, 1)
    phi = fc[0][2]
    assert -0.99 <= phi <= 0.99
    d = [fc[i + 1][1] - fc[i][1] for i in range(11)]
    for a, b in zip(d, d[1:]):
        if abs(a) > 1e-9:
            assert abs(b / a - phi) < 1e-6


def test_forecast_grid_picks_least_squares(spark):
    # a series that is exactly AR(1) in differences with phi = 0.5 and no noise
    w = [8.0]
    for _ in range(20):
        w.append(0.5 * w[-1] + (1.0 if len(w) % 2 else -1.0))
    ys = [0.0]
    for x in w:
        ys.append(ys[-1] + x)
    rows = [("s", dt.date(2000 + i // 12, i % 12 + 1, 1), y) for i, y in enumerate(ys)]
    m = spark.createDataFrame(rows, "k string, m date, v double")
    r = arima_111_forecast(m, "k", "m", "v", steps=1).first()
    # an independent search: the least sum of squares over a dense grid of the open square
    dense = min(_css(ys, p / 50, q / 50) for p in range(-49, 50) for q in range(-49, 50))
    assert _css(ys, r["Phi"], r["Theta"]) <= dense * 1.02 + 1e-9
    assert (r["Fit"] == "bound") == (max(abs(r["Phi"]), abs(r["Theta"])) > 0.9899)


def test_short_series_carry_their_last_level(spark):
    rows = [("one", dt.date(2020, 5, 1), 7.0), ("two", dt.date(2020, 1, 1), 1.0), ("two", dt.date(2020, 2, 1), 4.0)]
    rows += [("long", dt.date(2019, i + 1, 1), float(i * i % 7)) for i in range(10)]
    out = arima_111_forecast(spark.createDataFrame(rows, "k string, m date, v double"), "k", "m", "v", steps=3).collect()
    got = {k: sorted((r["Step"], r["ForecastDate"], r["Forecast"], r["Phi"], r["Fit"]) for r in out if r["k"] == k) for k in ("one", "two")}
    assert got["one"] == [(h, dt.date(2020, 5 + h, 1), 7.0, None, "short") for h in (1, 2, 3)]
    assert got["two"] == [(h, dt.date(2020, 2 + h, 1), 4.0, None, "short") for h in (1, 2, 3)]
    assert len(out) == 9


def test_forecast_reads_every_month(spark, tables01):
    from salesengine.plans import forecast, sales

    months = sales.sales_by_month(tables01).count()
    actual = forecast.actual_and_forecast(tables01).where("Kind = 'actual'").count()
    assert actual == months
    assert forecast.monthly_series(tables01, keep_partial_month=False).where("SeriesKey = 'ALL'").count() == months - 1


def _css(ys, phi, theta):
    w = [b - a for a, b in zip(ys, ys[1:])]
    e, s = 0.0, 0.0
    for i in range(1, len(w)):
        e = w[i] - phi * w[i - 1] - theta * e
        s += e * e
    return s


def test_refined_fit_never_worse(spark):
    ys = [100.0, 130.0, 90.0, 150.0, 120.0, 170.0, 110.0, 160.0, 140.0, 180.0, 120.0, 175.0, 150.0, 190.0]
    rows = [("s", dt.date(2020 + i // 12, i % 12 + 1, 1), y) for i, y in enumerate(ys)]
    m = spark.createDataFrame(rows, "k string, m date, v double")
    coarse = arima_111_forecast(m, "k", "m", "v", steps=1, refine=False).first()
    fine = arima_111_forecast(m, "k", "m", "v", steps=1).first()
    assert _css(ys, fine["Phi"], fine["Theta"]) <= _css(ys, coarse["Phi"], coarse["Theta"]) + 1e-9
    assert abs(fine["Phi"] - coarse["Phi"]) <= 0.1 + 1e-9


def test_every_product_has_a_forecast(spark, tables01):
    from salesengine.plans import forecast, sales

    m = forecast.product_monthly_series(tables01)
    assert m.select("SeriesKey").distinct().count() == tables01["lineitem"].select("l_partkey").distinct().count()
    total = sum(r["TotalSales"] for r in m.collect())
    want = sales.product_sales_window(tables01, as_of=dt.date(2100, 1, 1), years=200).collect()
    assert abs(total - sum(r["TotalSales"] for r in want)) < 1e-6 * total


def test_fit_tasks_follow_the_series(spark):
    rows = [(f"s{k}", dt.date(2020, h, 1), float(h * k)) for k in range(1500) for h in (1, 2)]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        out = arima_111_forecast(spark.createDataFrame(rows, "k string, m date, v double"), "k", "m", "v", steps=1)
        assert "RoundRobinPartitioning(8)" in out._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def _noise(seed, n, phi, theta):
    r = random.Random(seed)
    w, e, ys = 0.0, 0.0, [100.0]
    for _ in range(n):
        x = r.gauss(0, 5)
        w = phi * w + x + theta * e
        e = x
        ys.append(ys[-1] + w)
    return ys


def _loglik(ys, phi, theta):
    """-2 log likelihood less its constants, from the covariance matrix of the differences."""
    w = np.diff(np.array(ys))
    n = len(w)
    g = [(1 + 2 * phi * theta + theta * theta) / (1 - phi * phi)]
    g.append((1 + phi * theta) * (phi + theta) / (1 - phi * phi))
    while len(g) < n:
        g.append(phi * g[-1])
    c = np.array([[g[abs(i - j)] for j in range(n)] for i in range(n)])
    return n * math.log(w @ np.linalg.solve(c, w) / n) + np.linalg.slogdet(c)[1]


@pytest.mark.parametrize("phi, theta", [(0.6, 0.0), (-0.5, 0.3), (0.0, -0.7), (0.2, 0.6)])
def test_exact_likelihood_and_its_optimum(spark, phi, theta):
    ys = _noise(7, 60, phi, theta)
    w, n = np.diff(np.array(ys))[:, None], np.array([len(ys) - 1])
    for p, q in [(0.0, 0.0), (0.5, -0.3), (-0.9, 0.8), (0.99, 0.99)]:
        got, _ = arima.likelihood(w, n, np.array([[p]]), np.array([[q]]))
        assert abs(got[0, 0] - _loglik(ys, p, q)) < 1e-6 * abs(got[0, 0])
    rows = [("s", dt.date(2000 + i // 12, i % 12 + 1, 1), y) for i, y in enumerate(ys)]
    out = arima_111_forecast(spark.createDataFrame(rows, "k string, m date, v double"), "k", "m", "v", method="exact").collect()
    p, q = out[0]["Phi"], out[0]["Theta"]
    fine = min(_loglik(ys, a / 20, b / 20) for a in range(-19, 20) for b in range(-19, 20))
    assert _loglik(ys, p, q) <= fine + 1e-6
    near = min(_loglik(ys, p + a * 1e-3, q + b * 1e-3) for a in range(-3, 4) for b in range(-3, 4) if max(abs(p + a * 1e-3), abs(q + b * 1e-3)) < 0.999)
    assert out[0]["Fit"] == "bound" or _loglik(ys, p, q) <= near + 1e-6
    # the first forecast from the covariances of the differences
    gamma = [((1 + 2 * p * q + q * q), (1 + p * q) * (p + q))]
    lags = [gamma[0][0] / (1 - p * p), gamma[0][1] / (1 - p * p)]
    while len(lags) <= len(w):
        lags.append(p * lags[-1])
    c = np.array([[lags[abs(i - j)] for j in range(len(w))] for i in range(len(w))])
    step = np.array(lags[len(w):0:-1]) @ np.linalg.solve(c, w[:, 0])
    assert abs(min(out)["Forecast"] - (ys[-1] + step)) < 1e-6 * abs(ys[-1]) + 1e-6


def test_batches_and_lengths_do_not_show(spark):
    series = {f"s{k}": _noise(k, 5 + 7 * k, 0.4, 0.2) for k in range(12)}
    rows = [(k, dt.date(1990 + i // 12, i % 12 + 1, 1), y) for k, ys in series.items() for i, y in enumerate(ys)]
    for method in ("css", "exact"):
        together = arima_111_forecast(spark.createDataFrame(rows, "k string, m date, v double"), "k", "m", "v", steps=2, method=method).collect()
        alone = arima_111_forecast(spark.createDataFrame([r for r in rows if r[0] == "s5"], "k string, m date, v double"), "k", "m", "v", steps=2, method=method).collect()
        assert sorted(r for r in together if r["k"] == "s5") == sorted(alone)
    flat = [("c", dt.date(2001, m, 1), 4.0) for m in range(1, 9)]
    out = arima_111_forecast(spark.createDataFrame(flat, "k string, m date, v double"), "k", "m", "v", steps=2, method="exact").collect()
    assert [r["Forecast"] for r in out] == [4.0, 4.0]
