"""Exact COUNT(DISTINCT) of integer keys by bitmaps.

A key is a bit of the 4 KB bitmap of its bucket of 32,768 neighbouring keys.  A
group's bitmaps are built on the map side, merge by OR and count their bits, so
what is shuffled is a few bitmaps a group and task instead of every (group, key)
pair, and bitmaps of parts (of a month, say) can be kept and merged to those of
the whole.  That pays where groups have many keys; a group of a few scattered keys
needs a bitmap for each, so counts per customer stay with COUNT(DISTINCT).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def bitmaps(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, bucket, bits, rows: the bitmaps of ``column`` and the rows behind each; null keys count as rows only."""
    x = F.col(column).cast("long")
    return df.groupBy(*keys, F.bitmap_bucket_number(x).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits"), F.count(F.lit(1)).alias("rows"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps (``bitmaps``) of coarser groups."""
    return parts.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("rows").alias("rows"))


def rows_and_distinct(df: DataFrame, keys: list[str], column: str, rows: str, distinct: str) -> DataFrame:
    """keys, the number of rows and of different values of ``column``; columns that aren't integers are counted by Spark's own distinct."""
    if dict(df.dtypes)[column] not in _INTEGERS:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows), F.count_distinct(column).alias(distinct))
    return bitmaps(df, keys, column).groupBy(*keys).agg(F.sum("rows").alias(rows), F.sum(F.bitmap_count("bits")).alias(distinct))
