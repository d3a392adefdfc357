"""Equal-width histogram with matplotlib/numpy bin rules.

``bins`` equal bins over [min, max]; edge i = lo + i*(hi-lo)/bins; the last bin
is closed.  A value's bin is floor((x-lo) * bins/(hi-lo)), corrected against the
edges as numpy does; when hi == lo the range becomes [lo-0.5, lo+0.5].

The input column is materialised once (a reliable checkpoint in the shared
checkpoint folder), so the plan that produces it runs once although it is read
twice.  min and max come from one aggregate job and enter the binning job as two
literals (a scalar subquery here was re-planned at every use of the bound and
ran 40x slower); counts are a partial + final aggregate of at most ``bins``
rows, and the empty bins come from a ``bins``-row range frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from salesengine.session import reliable_checkpoint


def _bin_expr(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    step = (hi - lo) / F.lit(float(bins))

    def edge(i):
        return F.when(i >= F.lit(bins), hi).otherwise(lo + i.cast("double") * step)

    idx = F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))).cast("long")
    idx = F.when(idx >= F.lit(bins), F.lit(bins - 1)).otherwise(idx)
    idx = F.when(x < edge(idx), idx - 1).otherwise(idx)
    idx = F.when((x >= edge(idx + 1)) & (idx != F.lit(bins - 1)), idx + 1).otherwise(idx)
    return idx


def histogram(df: DataFrame, value: str | Column, bins: int = 20) -> DataFrame:
    """Bin, BinStart, BinEnd, Count for every one of ``bins`` bins (empty bins give 0)."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    vals = reliable_checkpoint(df.select(x.alias("x")).filter(F.col("x").isNotNull()))
    lo0, hi0 = vals.agg(F.min("x"), F.max("x")).first()
    if lo0 is None:  # no values: numpy's default range
        lo0, hi0 = 0.0, 1.0
    if lo0 == hi0:
        lo0, hi0 = lo0 - 0.5, hi0 + 0.5
    lo, hi = F.lit(float(lo0)), F.lit(float(hi0))
    counts = vals.select(_bin_expr(F.col("x"), lo, hi, bins).alias("Bin")).groupBy("Bin").agg(
        F.count(F.lit(1)).alias("Count"))
    spark = df.sparkSession
    grid = spark.range(bins).select(F.col("id").alias("Bin"))
    step = (hi - lo) / F.lit(float(bins))
    return grid.join(counts, "Bin", "left").select(
        "Bin",
        (lo + F.col("Bin").cast("double") * step).alias("BinStart"),
        F.when(F.col("Bin") == bins - 1, hi).otherwise(lo + (F.col("Bin") + 1).cast("double") * step).alias("BinEnd"),
        F.coalesce(F.col("Count"), F.lit(0)).cast("long").alias("Count"),
    ).orderBy("Bin")


def histogram_sql(values_sql: str, bins: int = 20) -> str:
    """The same histogram in DuckDB SQL; ``values_sql`` yields one DOUBLE column ``x``."""
    b = float(bins)
    return f"""WITH v AS (SELECT x FROM ({values_sql}) s WHERE x IS NOT NULL),
st0 AS (SELECT min(x) AS lo0, max(x) AS hi0 FROM v),
st AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
              CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM st0),
i0 AS (SELECT x, lo, hi, CAST(floor((x - lo) * ({b} / (hi - lo))) AS BIGINT) AS i FROM v, st),
i1 AS (SELECT x, lo, hi, CASE WHEN i >= {bins} THEN {bins - 1} ELSE i END AS i FROM i0),
i2 AS (SELECT x, lo, hi, CASE WHEN x < (CASE WHEN i >= {bins} THEN hi ELSE lo + CAST(i AS DOUBLE) * ((hi - lo) / {b}) END)
                          THEN i - 1 ELSE i END AS i FROM i1),
i3 AS (SELECT CASE WHEN x >= (CASE WHEN i + 1 >= {bins} THEN hi ELSE lo + CAST(i + 1 AS DOUBLE) * ((hi - lo) / {b}) END)
                        AND i <> {bins - 1} THEN i + 1 ELSE i END AS i FROM i2),
c AS (SELECT i, count(*) AS n FROM i3 GROUP BY i)
SELECT g.i AS Bin, lo + CAST(g.i AS DOUBLE) * ((hi - lo) / {b}) AS BinStart,
       CASE WHEN g.i = {bins - 1} THEN hi ELSE lo + CAST(g.i + 1 AS DOUBLE) * ((hi - lo) / {b}) END AS BinEnd,
       CAST(coalesce(c.n, 0) AS BIGINT) AS "Count"
FROM (SELECT range AS i FROM range({bins})) g CROSS JOIN st LEFT JOIN c ON c.i = g.i"""
