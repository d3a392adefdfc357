"""Skew experiment: B07 with one customer holding a third of 3M orders, naive plan vs implemented plan.

usage: python tools/skew_experiment.py <fresh scratch folder> [fanout]

``fanout``: B16 instead, with one product holding a third of 3M order lines spread over 25 suppliers:
the literal join (product x stock rows x sales rows) vs the implemented product of two aggregates.

Generated data (not a registered query): orders where every third order belongs to customer 1.
Broadcasts are off, as for fact-sized tables at scale.  Per plan it prints the wall time and, from the
event log written to the scratch folder, the shuffle stage whose busiest task read the most records.
"""

import glob
import io
import json
import os
import sys
import time

import zstandard

sys.path.insert(0, ".")
import salesengine.session as S  # noqa: E402


def main():
    d = sys.argv[1]
    os.makedirs(f"{d}/ev", exist_ok=True)
    S.DEFAULTS["spark.eventLog.enabled"] = "true"
    S.DEFAULTS["spark.eventLog.dir"] = f"{d}/ev"
    from pyspark.sql import functions as F

    from salesengine.functions.money import units_sum
    from salesengine.plans import customers
    from salesengine.sources import adapters as A
    from salesengine.sources.warehouse import load_tables

    spark = S.get_spark("local[8]", shuffle_partitions=16)
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(k, "-1")
    n = 3_000_000
    spark.range(n).select(
        F.col("id").alias("o_orderkey"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 100000 + 2).alias("o_custkey"),
        F.lit("O").alias("o_orderstatus"), ((F.col("id") % 1000) + 0.5).alias("o_totalprice"),
        F.expr("timestamp_ntz'1995-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 2000 as int))").alias("o_orderdate"),
        F.lit("1-URGENT").alias("o_orderpriority"),
    ).repartition(16).write.parquet(f"{d}/data/orders.parquet")
    spark.range(1, 100002).select(
        F.col("id").alias("c_custkey"), F.lit("c").alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"),
        F.lit(0.0).alias("c_acctbal"), F.lit("A").alias("c_mktsegment"),
    ).write.parquet(f"{d}/data/customer.parquet")
    t = load_tables(spark, f"{d}/data")
    fanout = "fanout" in sys.argv[2:]
    if fanout:
        spark.range(3_000_000).select(
            F.col("id").alias("l_orderkey"),
            F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 100000 + 2).alias("l_partkey"),
            (F.col("id") % 25 + 1).alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"),
            F.lit(10.0).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"),
            F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
            F.expr("timestamp_ntz'1995-01-01 00:00:00'").alias("l_shipdate"),
        ).repartition(16).write.parquet(f"{d}/data/lineitem.parquet")
        spark.range(1, 100002).select(F.col("id").alias("p_partkey"), F.concat(F.lit("p"), F.col("id") % 50).alias("p_name"),
                                      F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size"),
                                      F.lit(1.0).alias("p_retailprice")).write.parquet(f"{d}/data/part.parquet")
        t = load_tables(spark, f"{d}/data")
        from salesengine.plans import supply

        def naive_fanout(t):
            every = A.prod(t).join(A.inv(t), "ProductID").join(A.sod(t).select("ProductID", "SalesOrderDetailID"), "ProductID")
            return every.groupBy("ProductID", "Name", "Quantity").agg(F.count("SalesOrderDetailID").alias("n")).where("Quantity < 10")
        plans = [("naive", naive_fanout), ("implemented", supply.low_inventory_sellers)]

    def naive(t):
        orders = A.soh(t).select("CustomerID", "SalesOrderID", "TotalDueU", "OrderDate")
        return A.cust(t).join(orders, "CustomerID").groupBy("CustomerID").agg(
            F.count_distinct("SalesOrderID").alias("d"), units_sum("TotalDueU").alias("s"), F.max("OrderDate").alias("m"))

    sc = spark.sparkContext
    wall = {}
    if not fanout:
        plans = [("naive", naive), ("implemented", customers.customer_retention_exact)]
    for name, fn in plans * 2:
        sc.setJobGroup(name, name)
        t0 = time.perf_counter()
        fn(t).write.format("noop").mode("overwrite").save()
        wall.setdefault(name, []).append(round(time.perf_counter() - t0, 2))
    spark.stop()

    events = []
    for f in glob.glob(f"{d}/ev/*/*"):
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode("utf-8", "replace").splitlines():
            try:
                events.append(json.loads(line))
            except ValueError:
                pass
    stage_group, tasks = {}, {}
    for e in events:
        if e["Event"] == "SparkListenerJobStart":
            for s in e["Stage IDs"]:
                stage_group[s] = (e.get("Properties") or {}).get("spark.jobGroup.id")
        if e["Event"] == "SparkListenerTaskEnd":
            m = e.get("Task Metrics") or {}
            tasks.setdefault(e["Stage ID"], []).append(
                (e["Task Info"]["Finish Time"] - e["Task Info"]["Launch Time"],
                 (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)))
    for g in ("naive", "implemented"):
        rows = [(s, len(ts), sum(x[1] for x in ts), max(ts, key=lambda x: x[1])) for s, ts in tasks.items()
                if stage_group.get(s) == g and sum(x[1] for x in ts)]
        s, ntask, total, (ms, rec) = max(rows, key=lambda r: r[3][1])
        longest = max(x[0] for s2, ts in tasks.items() if stage_group.get(s2) == g for x in ts)
        print(f"{g}: wall {wall[g]} s; busiest shuffle task read {rec} of {total} records ({rec / total:.0%}) "
              f"in {ms} ms (stage {s}, {ntask} tasks); longest task {longest} ms")


if __name__ == "__main__":
    main()
