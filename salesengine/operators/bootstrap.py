"""Percentile bootstrap interval of a group mean (C02, C16), reproducible and scale-safe.

Replicate b of a group of n rows draws n row numbers, number j being
``u(b, j) * n >> 32`` with a 32-bit hash u of the group, b and j (Murmur3's
finishing mix; the same in Spark and DuckDB).  A replicate's mean is the sum of
the drawn values over n; the interval ends are the replicate means of nearest
rank floor(p*(B-1)), so no interpolation arithmetic is involved.

Rows of a group are cut into chunks of about ``chunk_rows`` by a hash of their id and
numbered within a chunk in the order of their ids.  A group of one chunk draws
from it directly.  For a larger group the n draws of each replicate are first
dealt to the chunks (a task counts them for one replicate, and keeps a count a
chunk), and each chunk then draws as many rows as fell to it, so no task ever has
more than one chunk, and the draws are still those of n numbers out of n.  A task
adds up a chunk's draws for a block of replicates as arrays: one row a replicate
and chunk comes out, whatever the number of rows.

Values are exact integers (e.g. money in ten-thousandths), summed as two longs
(multiples of 2^30 and the rest): exact for totals up to 10^28.  Null values are
left out; a group without values has no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.session import reliable_checkpoint

REPLICATES = 1001
CHUNK_ROWS = 1 << 16
BLOCK = 143  # replicates of a task's row: seven blocks of the default number
_PART = 1 << 30  # a value is hi * 2^30 + lo
_SLICE = 1 << 20  # draws at a time
_MASK = 0xFFFFFFFF
# fixed values: the multipliers of Murmur3's 32-bit finish, and odd ones for replicates, draws and chunks
_MIX = (0x85EBCA6B, 0xC2B2AE35)
_PER_REPLICATE, _PER_DRAW, _PER_CHUNK = 2654435761, 2246822519, 3266489917


def mixed(h: np.ndarray) -> np.ndarray:
    """Murmur3's finish of 32-bit numbers."""
    h = np.asarray(h, np.uint32)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint32(16))) * np.uint32(_MIX[0])
        h = (h ^ (h >> np.uint32(13))) * np.uint32(_MIX[1])
    return h ^ (h >> np.uint32(16))


def draws(seed: int, b: np.ndarray, start: int, stop: int, n: int) -> np.ndarray:
    """(len(b), stop - start) numbers below n: draws ``start`` to ``stop`` of each replicate."""
    with np.errstate(over="ignore"):
        of = mixed(np.uint32(seed) + np.asarray(b, np.uint32) * np.uint32(_PER_REPLICATE))
        u = mixed(of[:, None] + np.arange(start, stop, dtype=np.uint64).astype(np.uint32) * np.uint32(_PER_DRAW))
    return ((u.astype(np.uint64) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def chunk_seed(seed: int, chunk: int) -> int:
    return int(mixed(np.array([(seed + (chunk + 1) * _PER_CHUNK) & _MASK], np.uint32))[0])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a replicate's n draws fall to each chunk of a group."""
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            chunks = [c["chunk"] for c in row["chunks"]]
            ends = np.cumsum([c["size"] for c in row["chunks"]])
            counts = np.zeros(len(chunks), np.int64)
            for k in range(0, row["n"], _SLICE):
                at = draws(row["seed"], np.array([row["b"]]), k, min(row["n"], k + _SLICE), row["n"])[0]
                counts += np.bincount(np.searchsorted(ends, at, "right"), minlength=len(chunks))
            out += [(row["g"], c, row["b"], m) for c, m in zip(chunks, counts.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        types = (batch.schema.field("g").type, pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["g", "chunk", "b", "m"])


def _summed(replicates: int, chunk_rows: int):
    """Sums of a chunk's draws for a block of replicates; number -1 is the chunk itself."""
    def sums(values: np.ndarray, row: dict) -> Iterator[tuple[int, np.ndarray]]:
        first = row["block"] * BLOCK
        b = np.arange(first, min(first + BLOCK, replicates))
        if not row["block"]:
            yield -1, values.sum(0)
        if row["n"] <= chunk_rows:
            step = max(1, _SLICE // len(values))
            for k in range(0, len(b), step):
                drawn = draws(row["seed"], b[k:k + step], 0, len(values), len(values))
                yield from zip(b[k:k + step].tolist(), values[drawn].sum(1), strict=True)
            return
        seed = chunk_seed(row["seed"], row["chunk"])
        for x in b:
            m, total = row["draws"][x], np.zeros(2, np.int64)
            for k in range(0, m, _SLICE):
                total += values[draws(seed, np.array([x]), k, min(m, k + _SLICE), len(values))[0]].sum(0)
            yield int(x), total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows = batch.column("rows")
            flat, offsets = rows.flatten(), rows.offsets.to_numpy()
            start = offsets[0]
            both = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo")], 1)
            rest = batch.drop_columns(["rows"]).to_pylist()
            for row, lo, hi in zip(rest, offsets[:-1] - start, offsets[1:] - start, strict=True):
                out += [(row["g"], row["n"], x, int(t[0]), int(t[1])) for x, t in sums(both[lo:hi], row)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (batch.schema.field("g").type, *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["g", "n", "b", "hi", "lo"])
    return run


def bootstrap_ci(df: DataFrame, group: str, row_id: str, value: str, scale: float = 1.0,
                 replicates: int = REPLICATES, level: float = 0.95, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """group, Mean, N, CiLow, CiHigh.  ``group`` and ``row_id`` are string/integer columns; ``value`` an exact integer."""
    lo_p, hi_p = _rank_params(level)
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = F.col(value).cast("decimal(38,0)")
    rows = reliable_checkpoint(df.where(F.col(value).isNotNull()).select(
        F.col(group).alias("g"), F.col(row_id).alias("r"), F.call_function("div", x, F.lit(_PART)).alias("hi"), (x % F.lit(_PART)).cast("long").alias("lo")))
    kind = dict(rows.dtypes)["g"]
    sizes = rows.groupBy(F.col("g").alias("g2")).agg(F.count(F.lit(1)).alias("n"))
    chunk = F.pmod(F.xxhash64("r"), F.ceil(F.col("n") / chunk_rows)).alias("chunk")
    seed = F.conv(F.substring(F.md5(F.col("g").cast("string").cast("binary")), 1, 8), 16, 10).cast("long").alias("seed")
    numbered = rows.join(sizes, F.col("g").eqNullSafe(F.col("g2"))).select("g", "n", F.coalesce(seed, F.lit(0)).alias("seed"), chunk, "r", "hi", "lo")
    chunks = reliable_checkpoint(numbered.groupBy("g", "n", "seed", "chunk").agg(F.sort_array(F.collect_list(F.struct("r", "hi", "lo"))).alias("rows")))
    work = chunks.withColumn("draws", F.lit(None).cast("array<long>"))
    large = chunks.where(F.col("n") > chunk_rows)
    if not large.isEmpty():
        shape = F.sort_array(F.collect_list(F.struct("chunk", F.size("rows").alias("size"))))
        replicate = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b")
        asked = large.groupBy("g", "n", "seed").agg(shape.alias("chunks")).select("*", replicate)
        counts = asked.repartition(max(spread, replicates), "g", "b").mapInArrow(_dealt, f"g {kind}, chunk long, b long, m long")
        given = counts.groupBy(F.col("g").alias("g2"), F.col("chunk").alias("c2")).agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "m"))), lambda s: s["m"]).alias("given"))
        work = chunks.join(given, F.col("g").eqNullSafe(F.col("g2")) & (F.col("chunk") == F.col("c2")), "left").select(*chunks.columns, F.col("given").alias("draws"))
    # few bytes but much work a row: an explicit count, which adaptive execution doesn't merge
    blocks = work.select("*", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // BLOCK))).alias("block")).repartition(spread, "g", "chunk", "block")
    slim = blocks.withColumn("rows", F.transform("rows", lambda s: F.struct(s["hi"].cast("long").alias("hi"), s["lo"].alias("lo"))))
    sums = slim.mapInArrow(_summed(replicates, chunk_rows), f"g {kind}, n long, b long, hi long, lo long")
    total = F.sum("hi").cast("decimal(38,0)") * F.lit(_PART) + F.sum("lo")
    reps = sums.groupBy("g", "n", "b").agg(total.alias("t")).select("g", "n", "b", ((F.col("t").cast("double") / F.col("n").cast("double")) / F.lit(float(scale))).alias("v"))
    ranked = reps.groupBy("g", "n").agg(F.max(F.when(F.col("b") < 0, F.col("v"))).alias("Mean"), F.sort_array(F.collect_list(F.when(F.col("b") >= 0, F.col("v")))).alias("vs"))
    at = [(replicates - 1) * p // 1000 for p in (lo_p, hi_p)]
    return ranked.select(F.col("g").alias(group), "Mean", F.col("n").alias("N"), F.get("vs", F.lit(at[0])).alias("CiLow"), F.get("vs", F.lit(at[1])).alias("CiHigh"))


def _rank_params(level: float) -> tuple[int, int]:
    a = round((1 - level) / 2 * 1000)
    return a, 1000 - a


def bootstrap_ci_sql(rows_sql: str, group: str, scale: float = 1.0, replicates: int = REPLICATES,
                     level: float = 0.95) -> str:
    """DuckDB version for groups of one chunk; ``rows_sql`` yields columns g, r, x."""
    lo_p, hi_p = _rank_params(level)

    def finish(name: str, source: str) -> str:
        """Murmur3's finish of column h, in steps."""
        return f"""{name}_1 AS (SELECT * REPLACE ((xor(h, h >> 16) * CAST({_MIX[0]} AS UBIGINT)) & CAST({_MASK} AS UBIGINT) AS h) FROM {source}),
{name}_2 AS (SELECT * REPLACE ((xor(h, h >> 13) * CAST({_MIX[1]} AS UBIGINT)) & CAST({_MASK} AS UBIGINT) AS h) FROM {name}_1),
{name} AS (SELECT * REPLACE (xor(h, h >> 16) AS h) FROM {name}_2)"""

    return f"""WITH rows_ AS ({rows_sql}),
v AS (SELECT g, list(x ORDER BY r) AS xs, CAST(count(*) AS UBIGINT) AS n FROM rows_ WHERE x IS NOT NULL GROUP BY g),
b0 AS (SELECT g, n, b, (CAST('0x' || substr(md5(CAST(g AS VARCHAR)), 1, 8) AS UBIGINT) + CAST(b AS UBIGINT) * CAST({_PER_REPLICATE} AS UBIGINT)) & CAST({_MASK} AS UBIGINT) AS h
       FROM v, range({replicates}) t(b)),
{finish('b1', 'b0')},
d0 AS (SELECT g, n, b, (h + CAST(j AS UBIGINT) * CAST({_PER_DRAW} AS UBIGINT)) & CAST({_MASK} AS UBIGINT) AS h FROM (SELECT g, n, b, h, unnest(range(CAST(n AS BIGINT))) AS j FROM b1)),
{finish('d1', 'd0')},
reps AS (SELECT d.g, b, (CAST(sum(xs[CAST((h * d.n) >> 32 AS BIGINT) + 1]) AS DOUBLE) / CAST(any_value(d.n) AS DOUBLE)) / {float(scale)} AS m
         FROM d1 d JOIN v ON v.g = d.g GROUP BY d.g, b),
ranked AS (SELECT g, list(m ORDER BY m) AS ms FROM reps GROUP BY g)
SELECT g AS "{group}", ms[{(replicates - 1) * lo_p // 1000} + 1] AS CiLow, ms[{(replicates - 1) * hi_p // 1000} + 1] AS CiHigh FROM ranked"""
