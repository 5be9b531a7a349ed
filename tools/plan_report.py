"""Summarise the final (adaptive) physical plans of the bench queries.

Runs each query with Spark's event log written to a fresh scratch folder,
reads the last adaptive plan of every SQL execution, and prints a Markdown
table: scans (and their read schemas), shuffles, reused exchanges,
broadcasts, top-k window limits, bucketed scans and Python operators.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import glob
import io
import json
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import zstandard  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import bench  # noqa: E402
from forgecast.plans import catalog as Q  # noqa: E402
from forgecast.session import ensure_checkpoint_dir, ensure_workers_can_import  # noqa: E402


def read_events(folder):
    for d in glob.glob(os.path.join(folder, "*")):
        for f in sorted(glob.glob(os.path.join(d, "events*"))):
            raw = open(f, "rb")
            text = (io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
                    if f.endswith(".zstd") else open(f))
            for line in text:
                yield json.loads(line)


def final_plans(events):
    plans, desc = {}, {}
    for e in events:
        ev = e.get("Event", "")
        if ev.endswith("SparkListenerSQLExecutionStart"):
            desc[e["executionId"]] = e.get("description", "")
            plans[e["executionId"]] = e.get("physicalPlanDescription", "")
        elif ev.endswith("SparkListenerSQLAdaptiveExecutionUpdate"):
            plans[e["executionId"]] = e["physicalPlanDescription"]
    return plans


def summarise(plan: str) -> dict:
    tree, _, details = plan.partition("\n\n(")
    details = "(" + details
    if "== Final Plan ==" in tree:
        tree = tree.split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    ids = set(re.findall(r"\((\d+)\)", tree))
    blocks = {}
    for blk in details.split("\n\n"):
        m = re.match(r"\((\d+)\) (\S+)", blk)
        if m and m.group(1) in ids:
            blocks[m.group(1)] = (m.group(2), blk)
    names = [n for n, _ in blocks.values()]
    scans = [b for n, b in blocks.values() if n == "Scan"]
    return dict(
        scans=len(scans),
        shuffles=names.count("Exchange"),
        reused=names.count("ReusedExchange"),
        broadcast=names.count("BroadcastHashJoin"),
        smj=names.count("SortMergeJoin"),
        topk=names.count("WindowGroupLimit"),
        python=sum(names.count(k) for k in ("MapInPandas", "FlatMapGroupsInPandas",
                                            "FlatMapGroupsInArrow", "MapInArrow", "ArrowEvalPython")),
        bucketed=sum(1 for b in scans if "SelectedBucketsCount" in b or "Bucketed: true" in b),
        schemas=[m for b in scans for m in re.findall(r"ReadSchema: (struct<[^\n]*>)", b)],
    )


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    print("# Final physical plans of the bench queries\n")
    print(f"Data: `{sf_dir}`, local[8], 16 shuffle partitions, AQE on. Counts are per SQL")
    print("execution of the query's final adaptive plan. Generated by `tools/plan_report.py`.\n")
    print("| query | SQL executions | scans | shuffle exchanges | reused exchanges | broadcast joins | sort-merge joins | WindowGroupLimit | bucketed scans | Python ops |")
    print("|---|---|---|---|---|---|---|---|---|---|")
    all_schemas = {}
    for name in bench.HEADLINE:
        log_dir = tempfile.mkdtemp(prefix="forgecast-evlog-")
        spark = (SparkSession.builder.master("local[8]").appName("plans")
                 .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
                 .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
                 .config("spark.sql.shuffle.partitions", "16")
                 .config("spark.sql.session.timeZone", "UTC").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
        ensure_workers_can_import(spark)
        ensure_checkpoint_dir(spark)
        Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spark.stop()
        plans = final_plans(read_events(log_dir))
        tot = dict(scans=0, shuffles=0, reused=0, broadcast=0, smj=0, topk=0, python=0, bucketed=0)
        schemas = set()
        for p in plans.values():
            s = summarise(p)
            schemas |= set(s.pop("schemas"))
            for k in tot:
                tot[k] += s[k]
        all_schemas[name] = sorted(schemas)
        print(f"| `{name}` | {len(plans)} | {tot['scans']} | {tot['shuffles']} | {tot['reused']} | "
              f"{tot['broadcast']} | {tot['smj']} | {tot['topk']} | {tot['bucketed']} | {tot['python']} |")
    print("\n## Read schemas (column pruning at the scan)\n")
    for name, schemas in all_schemas.items():
        print(f"* `{name}`: " + "; ".join(f"`{s[:160]}`" for s in schemas))


if __name__ == "__main__":
    main()
