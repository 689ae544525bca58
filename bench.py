"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the tables and
the cores. Every query is run to its last row. The end-to-end queries compute everything
afresh; the read models use the stored run, whose making is timed as ``stored_runs``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cinderlog.plans.catalog import QUERIES, store  # noqa: E402
from cinderlog.session import local_session  # noqa: E402

HEADLINE = (
    "e01_analyze_text",
    "e02_analyze_ndjson",
    "e03_analyze_documents",
    "s05_numbered_file_lines",
    "p10_synthetic_clock",
    "p12_parse_text_lines",
    "p13_parse_json_lines",
    "n15_masked_tokens",
    "t02_leaf_routing",
    "t05_mine_log_templates",
    "t05_mine_document_templates",
    "t06_assign_events",
    "f04_dense_series",
    "a09_is_anomaly",
    "i02_ranked_ids",
    "j04_edge_details",
    "k01_kpis",
    "k04_timeline",
    "k09_insights",
    "k18_report",
    "l07_incident_detail",
    "m05_explanations",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "cinderlog-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}

    def timed(name: str, action) -> None:
        started = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{seconds[name]:8.2f}s {name}", file=sys.stderr, flush=True)

    def drain(name: str):
        def run() -> None:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

        return run

    for name in HEADLINE[:3]:
        timed(name, drain(name))
    timed("stored_runs", lambda: store(spark, sf_dir))
    for name in HEADLINE[3:]:
        timed(name, drain(name))
    result = {
        "metric": "headline queries, total wall clock",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
