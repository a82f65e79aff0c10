"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codegraph_spark.plans.lineage import scratch  # noqa: E402
from codegraph_spark.session import local_session  # noqa: E402
from codegraph_spark.workloads import QUERIES  # noqa: E402

HEADLINE = [
    "explode_lines", "lexical_usages", "extract_symbols", "link_lexical", "link_ranked", "enclosing_symbol", "resolve_modules",
    "symbols_by_name", "fuzzy_compact", "fuzzy_symbols", "snippet_search", "regex_scan", "resolve_chain", "references_query", "impact_expand",
    "pack_compact", "pack_full", "graph_query", "references_tree", "build_edges", "replace_plan_all", "patch_files",
    "parse_diagnostics", "history", "file_facts", "merge_base", "latency_stats", "scenario_flags", "category_counts", "telemetry_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("codegraph_bench", cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        with scratch(spark):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
