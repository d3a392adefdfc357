
from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

D = dt.datetime

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def make_tables(spark, **rows):
    """dict name -> DataFrame; tables not given are empty."""
    out = {}
    for name, schema in SCHEMAS.items():
        out[name] = spark.createDataFrame(rows.get(name, []), schema)
    return out


def nations():
    return [(0, "ALGERIA", 0), (1, "ARGENTINA", 1), (2, "BRAZIL", 1)]


def small_world(spark):
    """Three customers, four orders, two products sharing a name, one unsold product."""
    customer = [(1, "c1", 0, 10.0, "A"), (2, "c2", 1, 10.0, "B"), (3, "c3", 2, 10.0, "C")]
    part = [(10, "Widget", "b", "t", 1, 1.0), (11, "Widget", "b", "t", 1, 1.0), (12, "Gadget", "b", "t", 1, 1.0),
            (13, "Unsold", "b", "t", 1, 1.0)]
    orders = [
        (100, 1, "O", 100.0, D(2001, 7, 1), "1-URGENT"),
        (101, 1, "O", 50.0, D(2000, 1, 5), "4-NOT SPECIFIED"),
        (102, 2, "O", 70.0, D(2001, 8, 1), "2-HIGH"),
        (103, 3, "O", 30.0, D(1999, 3, 3), "3-MEDIUM"),
    ]
    lineitem = [
        (100, 10, 1, 1, 1.0, 40.0, 0.1, 0.0, "R", "O", D(2001, 7, 3)),
        (100, 12, 2, 2, 2.0, 60.0, 0.0, 0.0, "N", "O", D(2001, 6, 20)),
        (101, 11, 1, 1, 3.0, 50.0, 0.05, 0.0, "N", "O", D(2000, 1, 9)),
        (102, 10, 2, 1, 200.0, 70.0, 0.0, 0.0, "R", "O", D(2001, 8, 4)),
        (103, 12, 1, 1, 5.0, 30.0, 0.0, 0.0, "N", "O", D(1999, 3, 1)),
    ]
    supplier = [(1, "s1", 0, -7.5), (2, "s2", 1, 123.0), (4, "s4", 2, 55.9)]
    return make_tables(spark, customer=customer, part=part, orders=orders, lineitem=lineitem,
                       supplier=supplier, nation=nations())


def feedback_events(spark, n=50):
    rows = [(i, D(2024, 1, 1 + i % 28, i % 24), 100 + i % 7, "click", float(i), f'{{"k": {i}}}') for i in range(n)]
    return make_tables(spark, events=rows)


def struct(s: str) -> T.StructType:
    return T._parse_datatype_string(s)
