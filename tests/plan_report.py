"""Write PLANS.md: for every registered query, the shape of its physical
plan before execution (AQE may still improve it at run time): shuffles,
broadcasts, Python stages, and what each parquet scan reads."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarize(plan: str) -> dict:
    nodes = re.findall(r"^\(\d+\) (.+?)\s*$", plan, flags=re.M)
    exchanges = re.findall(r"Arguments: (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)[^\n]*", plan)
    scans = re.findall(r"Location: [^\[]*\[([^\]]*)\]\s*\n(?:.*\n)*?ReadSchema: ([^\n]*)", plan)
    return {
        "shuffles": sum(1 for n in nodes if n.startswith("Exchange")),
        "kinds": sorted(set(exchanges)),
        "broadcasts": sum(1 for n in nodes if n.startswith("BroadcastExchange")),
        "python": sorted({n for n in nodes if any(k in n for k in ("ArrowEvalPython", "MapInPandas", "MapInArrow", "BatchEvalPython", "FlatMapGroupsIn"))}),
        "scans": [(os.path.basename(loc.split(",")[0]), schema) for loc, schema in scans],
    }


def main() -> None:
    from sparkvox.session import local_session
    from __spark_entry__ import queries

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    lines = [
        "# Physical plans of the registered queries",
        "",
        f"Generated by `python tests/plan_report.py` on {sf} (8 shuffle partitions). Counts are from the",
        "plan before execution; AQE can still coalesce partitions, switch joins to broadcast and split",
        "skewed partitions at run time. The word table (`words-…`) is read from a table bucketed by",
        "doc_id, so per-document work after it needs no exchange. Queries with eager stages (fits, written",
        "intermediates) show the plan of their last stage.",
        "",
        "| Query | Exchanges | Broadcasts | Python stages | Parquet scans (ReadSchema) |",
        "|---|---|---|---|---|",
    ]
    for name, fn in queries().items():
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        s = summarize(plan)
        scans = "; ".join(f"{t}: `{sch}`" for t, sch in s["scans"]) or "—"
        lines.append(f"| `{name}` | {s['shuffles']} | {s['broadcasts']} | {', '.join(s['python']) or '—'} | {scans} |")
        print(name, s["shuffles"], s["broadcasts"], flush=True)
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main()
