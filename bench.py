"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR   table folder   (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores    (default 8)
    BENCH_QUERIES  comma-separated names, or ``all`` (default: the headline list)

Stage tables (features, scores, graph) are written once, before the clock starts, as the
pipeline does; ``feature_matrix`` and the other stage queries themselves run from the raw table.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flatten_events", "user_window_counts", "user_baselines", "baseline_zscores", "feature_matrix", "standardize",
    "isolation_forest_score", "knn_exact", "lof_score", "reconstruction_error", "best_f1_threshold", "ensemble_scores",
    "roc_auc", "compare_models", "alert_table", "overview_stats", "event_context", "best_pattern_match", "match_via_bridge",
    "similar_incidents", "event_graph", "triggers_indicator_edges", "knowledge_edges", "trace_path", "semantic_search",
    "entity_focus", "parse_incidents", "citation_metrics", "stream_window_counts",
    "read_audit_json", "enriched_alerts", "analyst_prompt", "incident_report_text",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from auditmill.plans import adapter, catalog
    from auditmill.session import build_session

    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    start = time.time()
    adapter.graph(spark, sf_dir)
    prepared = time.time() - start
    times, failed = {}, {}
    for name in names:
        start = time.time()
        try:
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        except Exception as error:  # a failing query must not hide the others
            failed[name] = str(error).splitlines()[0][:200]
        if os.environ.get("BENCH_VERBOSE"):
            print(f"{name} {times.get(name, 'failed')}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "failed": failed, "stage_tables_sec": round(prepared, 3),
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
