"""Consecutive identity keys (1, 2, 3, ... in a given order) without a global window.

The rows are range-partitioned and sorted on the order key, then written once
to reliable checkpoint storage so the partitioning cannot change between the
two passes.  Pass 1 counts rows per partition (one row per partition reaches
the driver); the offsets go back as a broadcast frame of that size, and each
row's key is start + offset(partition) + position inside the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from salesengine.session import reliable_checkpoint

_POS_BITS = 33  # monotonically_increasing_id = partition << 33 | position


def assign_identity(df: DataFrame, order_by: list[str | Column], id_col: str, start: int = 1) -> DataFrame:
    """``df`` plus ``id_col`` (long) numbering the rows from ``start`` in ``order_by`` order.

    ``order_by`` should be a unique key; ties get an arbitrary but fixed order.
    """
    spark = df.sparkSession
    ranged = reliable_checkpoint(df.repartitionByRange(*order_by).sortWithinPartitions(*order_by))
    tagged = ranged.select(
        "*", F.spark_partition_id().alias("_pid"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _POS_BITS) - 1)).alias("_pos"))
    counts = sorted((r["_pid"], r["n"]) for r in tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, acc = [], 0
    for pid, n in counts:
        offsets.append((pid, acc))
        acc += n
    off = spark.createDataFrame(offsets or [(0, 0)], "_pid int, _off long")
    return tagged.join(F.broadcast(off), "_pid").select(
        *[F.col(c) for c in df.columns],
        (F.lit(start) + F.col("_off") + F.col("_pos")).cast("long").alias(id_col))
