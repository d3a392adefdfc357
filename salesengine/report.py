"""The whole report: every catalogue query over a warehouse, results written out.

    python -m salesengine.report --tables /root/testdata/sf0.1 --out <shared folder> [key ...]

Intermediates several queries share are computed once.  Each result is written
as parquet to ``<out>/<key>`` by the executors (nothing is collected); the flagship result is also exported as CSV, as the reference
exports its first query.  A five-row preview of each result is logged (a
top-5 job, not a collect of the result).  Errors are raised, not swallowed.
"""

from __future__ import annotations

import argparse
import logging

from salesengine.plans.registry import QUERIES
from salesengine.session import get_spark, storage_root
from salesengine.sources.csv import export_csv
from salesengine.sources.warehouse import load_tables

CSV_EXPORTS = ("product_sales_window",)
# results that are word for word another query's: the same frame serves both
SAME_AS = {"customer_demographics": "customer_segments", "chart_product_sales": "product_sales_window"}
log = logging.getLogger("salesengine.report")


def run_report(spark, tables_dir: str, out: str, keys=None) -> dict[str, str]:
    """Run the queries on one Tables object that shares intermediates: an aggregate several queries
    use (monthly totals, product totals, customer segments, retention, territory x product) is
    computed once and checkpointed, not once per query."""
    t = load_tables(spark, tables_dir, share=True)
    written, frames = {}, {}
    for key in keys or list(QUERIES):
        src = SAME_AS.get(key)
        df = frames[src] if src in frames else QUERIES[key].on_tables(spark, t)
        frames[key] = df
        path = f"{out.rstrip('/')}/{key}"
        df.write.mode("overwrite").parquet(path)
        written[key] = path
        if key in CSV_EXPORTS:
            export_csv(df, f"{path}_csv")  # the frame keeps its order, files that are read again don't
        preview = df.limit(5).collect()
        log.info("%s -> %s\n%s", key, path, "\n".join(str(r) for r in preview))
    return written


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--tables", required=True, help="folder with <table>.parquet")
    ap.add_argument("--out", help="output folder (default: <spark.checkpoint.dir>/report)")
    ap.add_argument("--master", default=None)
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s - %(levelname)s - %(message)s")
    spark = get_spark(a.master)
    out = a.out or f"{storage_root(spark)}/report"
    run_report(spark, a.tables, out, a.keys)


if __name__ == "__main__":
    main()
