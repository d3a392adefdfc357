"""ARIMA(1,1,1) fit and multi-step forecast for every series at once.

For each series (one value per month; months without one count 0):
  w_t = y_t - y_{t-1};  w_t = phi*w_{t-1} + e_t + theta*e_{t-1}, no constant term, as the
  reference's fitted forecasts show;  y^_{T+h} = y_T + w^_1 + .. + w^_h with w^_h = phi*w^_{h-1}.

Two estimates of (phi, theta):

``css``: conditional least squares.  With e = 0 at the first difference the
residuals for a given theta are linear in phi, e = a - phi*b, where a and b are
the differences and their predecessors filtered by theta; so one pass over the
months gives, from the sums of a*a, a*b and b*b, the sum of squares for every
phi.  It is least on a grid (-0.9 .. 0.9 in steps of ``grid_step``) and then on
a finer one around that optimum (a tenth of the step, so within -0.99 .. 0.99).

``exact``: the Gaussian likelihood of the differences with the stationary start,
by the innovations recursion of an ARMA(1,1) (Brockwell and Davis, 5.3): with
r_0 = (1 + 2 phi theta + theta^2) / (1 - phi^2), r_t = 1 + theta^2 - theta^2/r_{t-1},
w^_1 = 0, w^_{t+1} = phi*w_t + theta*(w_t - w^_t)/r_{t-1}, the variance is
profiled out and n*ln(sum((w_t - w^_t)^2/r_{t-1})/n) + sum(ln r_{t-1}) is least.
The search is bounded: the grid of ``css``, then ``ZOOMS`` times a grid of a
tenth of the step around the best, to 0.0001 within -0.999 .. 0.999 (the last steps are cut
at that bound).

Ties go to the smaller (phi, theta).  Each grid contains the optimum of the one
before, so it can only improve the fit.  ``Fit`` tells how a series was fitted:
``inner``, ``bound`` (an optimum on the edge of the search: the series wants a
root on the unit circle), ``flat`` (``exact``: the likelihood doesn't change over
the last grid) or ``short`` (fewer than three months: the last level is carried on, without
parameters).  No series is left out.

Spark plan: one shuffle groups the monthly rows by series into an array (its
length is the number of months, bounded by the calendar, not by the data).  The
fit is map-only: Arrow batches of series are laid out as one array, time by
time, and a pass over the months updates all series and candidates of the batch
together.  Nothing reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINE = 9  # fine steps to either side: one less than a coarse step, so the edge of the unit square is never reached
ZOOMS = 3
LIMIT = 0.999
#: Series fitted together: bounds a task's memory.
BATCH = 500


def _edge(half: int, step: float, refine: bool) -> float:
    """The largest coefficient that the search can give, less a hair."""
    return half * step + (FINE * step / 10 if refine else 0) - 1e-9


def _half(grid_step: float) -> int:
    return int(round(0.9 / grid_step))


# ------------------------------------------------------------------ series as arrays

def dense(months: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One value a month from the first to the last of ``months`` (counted from year 0); those missing or NaN are 0."""
    out = np.zeros(int(months.max() - months.min()) + 1)
    out[months - months.min()] = np.nan_to_num(values)
    return out


def _laid_out(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First differences as (time, series), padded with 0, and each one's number of differences."""
    lengths = np.array([len(s) - 1 for s in series])
    out = np.zeros((int(lengths.max()), len(series)))
    for k, s in enumerate(series):
        out[:len(s) - 1, k] = s[1:] - s[:-1]
    return out, lengths


def _axis(centre: np.ndarray, half: int, step: float) -> np.ndarray:
    """(series, candidates) around each centre."""
    return centre[:, None] + np.arange(-half, half + 1).astype(float) * step


def _least(score: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least score of (series, phi, theta), ties to the smaller phi, then theta, as both ascend; scores that aren't numbers lose."""
    flat = np.where(np.isnan(score), np.inf, score).reshape(len(score), -1)
    i, j = np.divmod(flat.argmin(1), theta.shape[1])
    rows = np.arange(len(score))
    return phi[rows, i], theta[rows, j]


def _css_grid(w: np.ndarray, n: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shape = theta.shape
    a, b, aa, ab, bb = (np.zeros(shape) for _ in range(5))
    for t in range(1, len(w)):
        here = (t < n)[:, None]
        na = w[t][:, None] - theta * a
        nb = w[t - 1][:, None] - theta * b
        a, b = np.where(here, na, a), np.where(here, nb, b)
        aa, ab, bb = (x + np.where(here, y, 0.0) for x, y in ((aa, na * na), (ab, na * nb), (bb, nb * nb)))
    p = phi[:, :, None]
    return _least((aa[:, None, :] - 2.0 * p * ab[:, None, :]) + p * p * bb[:, None, :], phi, theta)


def fit_css(w: np.ndarray, n: np.ndarray, grid_step: float, refine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phi, theta, next difference) of each series."""
    half, zero = _half(grid_step), np.zeros(len(n))
    phi, theta = _css_grid(w, n, _axis(zero, half, grid_step), _axis(zero, half, grid_step))
    if refine:
        phi, theta = _css_grid(w, n, _axis(phi, FINE, grid_step / 10), _axis(theta, FINE, grid_step / 10))
    e = np.zeros(len(n))
    for t in range(1, len(w)):
        e = np.where(t < n, w[t] - phi * w[t - 1] - theta * e, e)
    return phi, theta, phi * w[n - 1, np.arange(len(n))] + theta * e


def likelihood(w: np.ndarray, n: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(-2 log likelihood less its constants, next difference) for (series, candidates) of phi and theta."""
    tt = theta * theta
    r = (1.0 + 2.0 * phi * theta + tt) / (1.0 - phi * phi)
    hat, total, logs = np.zeros(phi.shape), np.zeros(phi.shape), np.zeros(phi.shape)
    for t in range(len(w)):
        here = (t < n)[:, None]
        x = w[t][:, None]
        v = x - hat
        total = total + np.where(here, v * v / r, 0.0)
        logs = logs + np.where(here, np.log(r), 0.0)
        hat = np.where(here, phi * x + theta * v / r, hat)
        r = np.where(here, 1.0 + tt - tt / r, r)
    count = n[:, None].astype(float)
    with np.errstate(divide="ignore"):
        return count * np.log(total / count) + logs, hat


def _exact_grid(w: np.ndarray, n: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, m = phi.shape[1], theta.shape[1]
    score, _ = likelihood(w, n, np.repeat(phi, m, 1), np.tile(theta, k))
    spread = score.max(1) - score.min(1)
    return *_least(score.reshape(len(n), k, m), phi, theta), spread


def fit_exact(w: np.ndarray, n: np.ndarray, grid_step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(phi, theta, next difference, whether the likelihood was flat over the last grid) of each series."""
    half, zero = _half(grid_step), np.zeros(len(n))
    phi, theta, spread = _exact_grid(w, n, _axis(zero, half, grid_step), _axis(zero, half, grid_step))
    for zoom in range(1, ZOOMS + 1):
        step = grid_step / 10**zoom
        phi, theta, spread = _exact_grid(w, n, *(np.clip(_axis(x, FINE, step), -LIMIT, LIMIT) for x in (phi, theta)))
    return phi, theta, likelihood(w, n, phi[:, None], theta[:, None])[1][:, 0], spread < 1e-9


def _path(level: np.ndarray, first: np.ndarray, phi: np.ndarray, steps: int) -> np.ndarray:
    out, w = np.empty((len(level), steps)), first
    for h in range(steps):
        level = level + w
        out[:, h] = level
        w = phi * w
    return out


# ------------------------------------------------------------------ Spark

_FITTED = ["Path", "Phi", "Theta", "Fit"]


def _fitter(key: str, method: str, steps: int, grid_step: float, fill: bool, refine: bool):
    edge = LIMIT - 1e-9 if method == "exact" else _edge(_half(grid_step), grid_step, refine)

    def fitted(ys: list[np.ndarray]) -> list[list]:
        out: list[list] = [[[float(y[-1])] * steps, None, None, "short"] for y in ys]
        long = [k for k, y in enumerate(ys) if len(y) >= 3]
        for k in range(0, len(long), BATCH):
            part = long[k:k + BATCH]
            w, n = _laid_out([ys[i] for i in part])
            if method == "exact":
                phi, theta, first, flat = fit_exact(w, n, grid_step)
            else:
                (phi, theta, first), flat = fit_css(w, n, grid_step, refine), np.zeros(len(n), bool)
            path = _path(np.array([ys[i][-1] for i in part]), first, phi, steps)
            bound = np.maximum(np.abs(phi), np.abs(theta)) >= edge
            for row, i in enumerate(part):
                out[i] = [path[row].tolist(), float(phi[row]), float(theta[row]), "flat" if flat[row] else "bound" if bound[row] else "inner"]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_rows")
            flat, cuts = rows.flatten(), np.cumsum(np.diff(rows.offsets.to_numpy()))[:-1]
            months = np.split(flat.field("month").to_numpy().astype(np.int64), cuts)
            values = np.split(flat.field("value").to_numpy(zero_copy_only=False), cuts)  # null: NaN
            got = fitted([dense(m, v) if fill else np.nan_to_num(v) for m, v in zip(months, values, strict=True)])
            types = (pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.string())
            columns = [pa.array([g[i] for g in got], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("_last"), *columns], names=[key, "_last", *_FITTED])
    return run


def arima_111_forecast(monthly: DataFrame, key: str, period: str, value: str, steps: int = 12,
                       grid_step: float = 0.1, fill: bool = True, refine: bool = True, method: str = "css") -> DataFrame:
    """key, Step, ForecastDate, Forecast, Phi, Theta, Fit: ``steps`` rows per series.

    ``period`` is the first day of a month, at most one row a month and series; ``method`` is ``css`` or ``exact``.
    """
    if method not in ("css", "exact"):
        raise ValueError(f"no method {method}")
    # an explicit number of partitions: rows are few and small, so AQE would put all into one task, but each is a fit
    spread = int(monthly.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    month = (F.year(period) * 12 + F.month(period)).alias("month")
    row = F.struct(month, F.col(value).cast("double").alias("value"))
    rows = monthly.select(key, F.col(period).alias("_period"), row.alias("_row")).repartition(spread, key)
    series = rows.groupBy(key).agg(F.max("_period").alias("_last"), F.sort_array(F.collect_list("_row")).alias("_rows"))
    kinds = dict(series.dtypes)
    schema = f"`{key}` {kinds[key]}, _last {kinds['_last']}, Path array<double>, Phi double, Theta double, Fit string"
    fitted = series.mapInArrow(_fitter(key, method, steps, grid_step, fill, refine), schema)
    return fitted.select(key, "_last", F.posexplode("Path").alias("pos", "Forecast"), "Phi", "Theta", "Fit").select(
        key, (F.col("pos") + 1).cast("long").alias("Step"), F.add_months("_last", F.col("pos") + 1).alias("ForecastDate"), "Forecast", "Phi", "Theta", "Fit")


def _series_sql(monthly_sql: str) -> str:
    return f"""m AS ({monthly_sql}),
b AS (SELECT k, min(period) AS lo, max(period) AS hi FROM m GROUP BY k),
cal AS (SELECT k, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM b),
y AS (SELECT cal.k, cal.period, coalesce(m.v, CAST(0.0 AS DOUBLE)) AS v FROM cal LEFT JOIN m
      ON m.k = cal.k AND m.period = cal.period),
s AS (SELECT k, list(v ORDER BY period) AS ys, max(period) AS last FROM y GROUP BY k),
s2 AS (SELECT k, last, ys[len(ys)] AS y_last,
              list_transform(generate_series(2, len(ys)), lambda i: ys[i] - ys[i - 1]) AS w FROM s WHERE len(ys) >= 3)"""


def _css_level_sql(name: str, source: str, phi: str, theta: str, half: int, step: float) -> str:
    """The best candidate of ``source`` (k, last, y_last, w and a centre): one fold a theta, all phi from its sums."""
    side = 2 * half + 1
    a, b = "(x - theta * acc.a)", "(acc.pw - theta * acc.b)"
    return f"""{name}_t AS (SELECT k, last, y_last, w, {phi} AS phi0, {theta} + CAST(j - {half} AS DOUBLE) * {step!r} AS theta FROM {source}, range({side}) t(j)),
{name}_f AS (SELECT *, list_reduce(w[2:], lambda acc, x: {{'pw': x, 'a': {a}, 'b': {b}, 'aa': acc.aa + {a} * {a}, 'ab': acc.ab + {a} * {b}, 'bb': acc.bb + {b} * {b}}},
      {{'pw': w[1], 'a': CAST(0.0 AS DOUBLE), 'b': CAST(0.0 AS DOUBLE), 'aa': CAST(0.0 AS DOUBLE), 'ab': CAST(0.0 AS DOUBLE), 'bb': CAST(0.0 AS DOUBLE)}}) AS f FROM {name}_t),
{name}_p AS (SELECT k, last, y_last, w, phi0 + CAST(i - {half} AS DOUBLE) * {step!r} AS phi, theta, f FROM {name}_f, range({side}) t(i)),
{name} AS (SELECT k, arg_min({{'phi': phi, 'theta': theta, 'last': last, 'y_last': y_last, 'w': w}},
                   {{'s': (f.aa - CAST(2.0 AS DOUBLE) * phi * f.ab) + phi * phi * f.bb, 'phi': phi, 'theta': theta}}) AS c FROM {name}_p GROUP BY k)"""


def _forecast_sql(steps: int, fit: str) -> str:
    """From ``done`` (k, last, y_last, phi, theta, w1 = the next difference) and ``s``."""
    return f"""path AS (SELECT *, list_reduce(generate_series(1, {steps}),
            lambda acc, h: {{'wh': phi * acc.wh, 'lvl': acc.lvl + acc.wh, 'out': list_append(acc.out, acc.lvl + acc.wh)}},
            {{'wh': w1, 'lvl': y_last, 'out': CAST([] AS DOUBLE[])}}).out AS out FROM done)
SELECT k, CAST(h AS BIGINT) AS Step, CAST(last + to_months(CAST(h AS INTEGER)) AS DATE) AS ForecastDate,
       out[h] AS Forecast, phi AS Phi, theta AS Theta, {fit} AS Fit
FROM path, range(1, {steps} + 1) r(h)
UNION ALL SELECT k, CAST(h AS BIGINT), CAST(last + to_months(CAST(h AS INTEGER)) AS DATE), ys[len(ys)], NULL, NULL, 'short'
FROM s, range(1, {steps} + 1) r(h) WHERE len(ys) < 3"""


def arima_111_forecast_sql(monthly_sql: str, steps: int = 12, grid_step: float = 0.1) -> str:
    """DuckDB version of ``css``; ``monthly_sql`` yields (k VARCHAR, period DATE, v DOUBLE)."""
    half = _half(grid_step)
    zero = "CAST(0.0 AS DOUBLE)"
    return f"""WITH {_series_sql(monthly_sql)},
{_css_level_sql("coarse", "s2", zero, zero, half, grid_step)},
centre AS (SELECT k, c.last AS last, c.y_last AS y_last, c.w AS w, c.phi AS phi, c.theta AS theta FROM coarse),
{_css_level_sql("fine", "centre", "phi", "theta", FINE, grid_step / 10)},
best AS (SELECT k, c.last AS last, c.y_last AS y_last, c.w AS w, c.phi AS phi, c.theta AS theta FROM fine),
done AS (SELECT k, last, y_last, phi, theta, phi * w[len(w)] + theta * list_reduce(w[2:],
           lambda acc, x: {{'pw': x, 'e': x - phi * acc.pw - theta * acc.e}}, {{'pw': w[1], 'e': CAST(0.0 AS DOUBLE)}}).e AS w1 FROM best),
{_forecast_sql(steps, f"CASE WHEN greatest(abs(phi), abs(theta)) >= {_edge(half, grid_step, True)!r} THEN 'bound' ELSE 'inner' END")}"""


def arima_111_exact_sql(monthly_sql: str, steps: int = 12, grid_step: float = 0.1) -> str:
    """DuckDB version of ``exact``."""
    half = _half(grid_step)
    r = "acc.r"
    v = "(x - acc.hat)"
    state = (f"lambda acc, x: {{'hat': phi * x + theta * {v} / {r}, 'r': CAST(1.0 AS DOUBLE) + theta * theta - theta * theta / {r}, "
             f"'total': acc.total + {v} * {v} / {r}, 'logs': acc.logs + ln({r})}}")
    start = ("{'hat': CAST(0.0 AS DOUBLE), 'r': (CAST(1.0 AS DOUBLE) + CAST(2.0 AS DOUBLE) * phi * theta + theta * theta) / (CAST(1.0 AS DOUBLE) - phi * phi), "
             "'total': CAST(0.0 AS DOUBLE), 'logs': CAST(0.0 AS DOUBLE)}")
    levels = []
    for zoom in range(ZOOMS + 1):
        reach, step = (half, grid_step) if not zoom else (FINE, grid_step / 10**zoom)
        side = 2 * reach + 1

        def cut(x: str, i: str, reach=reach, step=step, zoom=zoom) -> str:
            value = f"{x} + CAST({i} - {reach} AS DOUBLE) * {step!r}"
            return f"least(greatest({value}, CAST(-{LIMIT} AS DOUBLE)), CAST({LIMIT} AS DOUBLE))" if zoom else value

        source = "(SELECT k, last, y_last, w, CAST(0.0 AS DOUBLE) AS phi, CAST(0.0 AS DOUBLE) AS theta FROM s2)" if not zoom else f"z{zoom - 1}"
        levels.append(f"""g{zoom} AS (SELECT k, last, y_last, w, {cut('phi', f'g // {side}')} AS phi, {cut('theta', f'g % {side}')} AS theta FROM {source}, range({side * side}) t(g)),
l{zoom} AS (SELECT *, list_reduce(w, {state}, {start}) AS f FROM g{zoom}),
v{zoom} AS (SELECT *, CAST(len(w) AS DOUBLE) * CASE WHEN f.total = 0 THEN CAST('-inf' AS DOUBLE) ELSE ln(f.total / CAST(len(w) AS DOUBLE)) END + f.logs AS score FROM l{zoom}),
b{zoom} AS (SELECT k, max(score) - min(score) AS spread, arg_min({{'phi': phi, 'theta': theta, 'last': last, 'y_last': y_last, 'w': w, 'f': f}}, {{'s': score, 'phi': phi, 'theta': theta}}) AS c FROM v{zoom} GROUP BY k),
z{zoom} AS (SELECT k, spread, c.last AS last, c.y_last AS y_last, c.w AS w, c.phi AS phi, c.theta AS theta, c.f.hat AS w1 FROM b{zoom})""")
    fit = f"CASE WHEN spread < 1e-9 THEN 'flat' WHEN greatest(abs(phi), abs(theta)) >= {LIMIT - 1e-9!r} THEN 'bound' ELSE 'inner' END"
    return f"""WITH {_series_sql(monthly_sql)},
{", ".join(levels)},
done AS (SELECT * FROM z{ZOOMS}),
{_forecast_sql(steps, fit)}"""
