"""The warehouse as a set of lazily scanned parquet tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from salesengine.session import reliable_checkpoint

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


# Declared schemas of the driver tables: scans need no schema-inference job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Tables(Mapping):
    """Name -> DataFrame over ``{root}/{name}.parquet``; each scan is created on first use.

    Scans are plain parquet relations, so Catalyst prunes columns and pushes
    filters into every one of them.  Known tables are read with their declared
    schema (no inference job); ``infer=True`` reads the files' own schema.
    """

    def __init__(self, spark: SparkSession, root: str, names: Iterable[str] = TABLE_NAMES, infer: bool = False,
                 share: bool = False):
        self.spark = spark
        self.infer = infer
        self.share = share
        self._shared: dict[str, DataFrame] = {}
        self.memo: dict = {}
        self.root = root.rstrip("/")
        self._names = tuple(names)
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._frames:
            reader = self.spark.read
            if not self.infer and name in SCHEMAS:
                reader = reader.schema(SCHEMAS[name])
            self._frames[name] = reader.parquet(f"{self.root}/{name}.parquet")
        return self._frames[name]

    def __iter__(self):
        return iter(self._names)

    def __len__(self):
        return len(self._names)

    def shared(self, name: str, build) -> DataFrame:
        """An intermediate several queries use: built once and checkpointed when sharing is on.

        With ``share`` off (one query per Tables object) the plan is returned as is.
        """
        if not self.share:
            return build()
        if name not in self._shared:
            self._shared[name] = reliable_checkpoint(build())
        return self._shared[name]

    def register_views(self) -> None:
        for name in self._names:
            self[name].createOrReplaceTempView(name)


def load_tables(spark: SparkSession, root: str, share: bool = False) -> Tables:
    return Tables(spark, root, share=share)


def shared(t, name: str, build) -> DataFrame:
    """``t.shared`` when ``t`` is a Tables object; plain mappings (tests) just build."""
    fn = getattr(t, "shared", None)
    return fn(name, build) if fn is not None else build()


def run_query(spark: SparkSession, tables: Tables, sql: str) -> DataFrame:
    """Run SQL text over the warehouse and the adapter views (the reference's ``retrieve_data``).

    Errors are raised, not swallowed into an empty frame.
    """
    from salesengine.sources.adapters import register_adapter_views

    tables.register_views()
    register_adapter_views(tables)
    return spark.sql(sql)
