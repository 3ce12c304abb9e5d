"""Summarize the physical plan of every registered query (PLANS.md table).

usage: python scripts/plan_report.py [sf_dir] > PLANS_table.md
Counts, from ``explain("formatted")`` of the final adaptive plan: parquet
scans, shuffle exchanges, broadcast exchanges, join strategies, aggregate
kinds, partial window group limits, and whether filters reached the scan.
Queries that write (sinks, streaming) are executed by the call itself; their
plan is the read-back plan.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mintlens.plans.queries import QUERIES  # noqa: E402
from mintlens.session import build_session  # noqa: E402

WRITES = {"stream_capture", "append_idempotent", "write_view", "capture_only", "read_catalog", "read_book_snapshots",
          "run_backfill", "retain_sink", "read_blocks", "block_quarantine", "replayed_sales", "captured_status", "apply_holdings_table", "apply_book_table",
          "normalize_holdings", "read_mappings"}


def summarize(plan: str) -> dict:
    tree = plan.split("\n\n")[0].split("== Initial Plan ==")[0]
    nodes = [m.group(1) for m in re.finditer(r"^[\s:+|*-]*([A-Za-z]+)[^\n]*\(\d+\)\s*$", tree, re.M)]
    c = lambda n: sum(1 for x in nodes if x == n)
    scan_ids = set(re.findall(r"Scan parquet\s+\((\d+)\)", tree))
    details = {m.group(1): m.group(2) for m in re.finditer(r"^\((\d+)\) Scan parquet[^\n]*\n(.*?)(?=^\(\d+\) |\Z)",
                                                       plan, re.M | re.S)}
    pushed = [re.search(r"PushedFilters: \[(.*?)\]", details.get(i, "")) for i in scan_ids]
    pushed = [m.group(1) for m in pushed if m]
    return {
        "scans": len(re.findall(r"Scan parquet", tree)),
        "shuffles": c("Exchange"),
        "reused": c("ReusedExchange"),
        "broadcasts": c("BroadcastExchange"),
        "joins": ", ".join(f"{k}×{v}" for k, v in (("BHJ", c("BroadcastHashJoin")), ("SMJ", c("SortMergeJoin")),
                                                   ("SHJ", c("ShuffledHashJoin")),
                                                   ("BNLJ", c("BroadcastNestedLoopJoin"))) if v) or "-",
        "aggs": ", ".join(f"{k}×{v}" for k, v in (("Hash", c("HashAggregate")), ("ObjectHash", c("ObjectHashAggregate")),
                                                  ("Sort", c("SortAggregate"))) if v) or "-",
        "window_limit": "partial+final" if "Partial" in plan and c("WindowGroupLimit") else "-",
        "pushed": sum(1 for p in pushed if p.strip()),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session()
    print("| query | parquet scans | shuffles | reused | broadcasts | joins | aggregates | top-n limit | scans with pushed filters |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        df.collect()  # execute, so explain shows the final adaptive plan (stage reuse, runtime joins)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        s = summarize(buf.getvalue())
        label = f"`{name}`" + (" (writes; read-back plan)" if name in WRITES else "")
        print(f"| {label} | {s['scans']} | {s['shuffles']} | {s['reused']} | {s['broadcasts']} | {s['joins']} | {s['aggs']} | "
              f"{s['window_limit']} | {s['pushed']} |")
    spark.stop()


if __name__ == "__main__":
    main()
