"""Tables in an external RDBMS through Spark's JDBC source.

Reads are split into ``num_partitions`` range queries on a numeric column so
the load is parallel; writes go in batches of 10,000 rows (the reference's
chunk size) from every partition.  The driver jar of the target database
must be on the classpath.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 10000


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 8,
              fetch_size: int = BATCH_ROWS, properties: dict[str, str] | None = None) -> DataFrame:
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch_size)
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partitioned JDBC read needs lower and upper bounds")
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch_size: int = BATCH_ROWS,
               properties: dict[str, str] | None = None) -> None:
    """``mode`` is 'append' or 'overwrite' (the reference's replace)."""
    if mode not in ("append", "overwrite"):
        raise ValueError(mode)
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch_size)
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.mode(mode).save()
