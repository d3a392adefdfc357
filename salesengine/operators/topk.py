"""Top-k / bottom-k with a unique tie-break (S6).  Planned as TakeOrderedAndProject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """First ``k`` rows in ``order`` (``order`` must end in a unique key)."""
    return df.orderBy(*order).limit(k)


def bottom_k(df: DataFrame, k: int, order: list[Column], reverse: list[Column]) -> DataFrame:
    """Last ``k`` rows in ``order`` (pandas ``tail``), returned in ``order``.

    Read as the first ``k`` in the reversed order, then re-sorted; never a
    driver-side tail.
    """
    return df.orderBy(*reverse).limit(k).orderBy(*order)
