"""Orders and order lines stored by order key, so that joining them needs no shuffle.

A load job writes both tables hashed into the same number of buckets by order
key and sorted by it within a bucket, one file a bucket.  A join on that key then
reads bucket by bucket: no exchange below it, whatever else the query does (and no
sort, where the session lets Spark trust the files' order:
``spark.sql.legacy.bucketedTableScan.outputOrdering``).  The files are plain parquet; the number of buckets is in the
folder's name, and ``BucketedTables`` tells a session's catalog of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from salesengine.session import storage_root
from salesengine.sources.warehouse import SCHEMAS, Tables

KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(tables: Tables, folder: str | None = None, buckets: int | None = None) -> str:
    """Writes orders and lineitem by order key; returns the folder they are in (a fresh one unless given)."""
    spark = tables.spark
    buckets = buckets or default_buckets(spark)
    root = f"{folder or f'{storage_root(spark)}/bucketed/{uuid.uuid4().hex[:12]}'}/{buckets}"
    for name, key in KEYS.items():
        table = f"bucketed_{uuid.uuid4().hex[:12]}"
        rows = tables[name].repartition(buckets, key)  # one writer a bucket
        rows.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", f"{root}/{name}").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # the files stay
    return root


class BucketedTables(Tables):
    """The tables of ``root``, with orders and lineitem as ``write_bucketed`` left them in ``folder``."""

    def __init__(self, spark: SparkSession, root: str, folder: str, share: bool = False):
        super().__init__(spark, root, share=share)
        self.folder = folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        if name in KEYS and name not in self._frames:
            table, buckets = f"bucketed_{uuid.uuid4().hex[:12]}", int(self.folder.rsplit("/", 1)[-1])
            self.spark.sql(f"CREATE TABLE {table} ({SCHEMAS[name]}) USING parquet CLUSTERED BY ({KEYS[name]}) SORTED BY ({KEYS[name]}) "
                           f"INTO {buckets} BUCKETS LOCATION '{self.folder}/{name}'")
            self._frames[name] = self.spark.table(table)
        return super().__getitem__(name)
