"""Print plan statistics per registered query with broadcasts limited to tiny tables (a stand-in for scale).

usage: python tools/plans.py [sf_dir] [key ...]   (prints the formatted plan when keys are given)
       python tools/plans.py --markdown [sf_dir]  (the table of PLANS.md)
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

sys.path.insert(0, ".")
from salesengine.plans.registry import QUERIES  # noqa: E402
from salesengine.session import get_spark  # noqa: E402


def main():
    args = sys.argv[1:]
    markdown = "--markdown" in args
    args = [a for a in args if a != "--markdown"]
    sf_dir = args[0] if args else "/root/testdata/sf0.1"
    keys = args[1:]
    spark = get_spark("local[8]")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(8 * 1024))
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(8 * 1024))
    qs = QUERIES
    for k in keys or list(qs):
        df = qs[k](spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        plan = buf.getvalue()
        tree = plan.split("\n\n\n", 1)[0]
        stats = {
            "shuffles": len(re.findall(r"(?<![A-Za-z])Exchange", tree)),
            "broadcasts": len(re.findall("BroadcastExchange", tree)),
            "sort-merge joins": len(re.findall("SortMergeJoin", tree)),
            "broadcast joins": len(re.findall("BroadcastHashJoin", tree)),
            "aggregates": len(re.findall("HashAggregate", tree)),
            "windows": len(re.findall(r"(?<![A-Za-z])Window", tree)),
            "scans": len(re.findall("Scan ", tree)),
            "generates": len(re.findall("Generate", tree)),
        }
        if markdown:
            print(f"| `{k}` | " + " | ".join(str(v) for v in stats.values()) + " |")
            continue
        print(f"{k:30s} " + " ".join(f"{n}={v}" for n, v in stats.items()))
        if keys:
            print(tree)


if __name__ == "__main__":
    main()
