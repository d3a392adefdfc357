"""JDBC source/sink argument handling.  No database is started, so no connection is made here."""

import pytest

from salesengine.sources.jdbc import BATCH_ROWS, read_jdbc, write_jdbc


def test_partitioned_read_needs_bounds(spark):
    with pytest.raises(ValueError):
        read_jdbc(spark, "jdbc:none://x", "t", partition_column="id")


def test_write_mode_is_append_or_overwrite(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        write_jdbc(df, "jdbc:none://x", "t", mode="ignore")


def test_batch_size_matches_reference_chunks():
    assert BATCH_ROWS == 10000
