"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once after a short warm-up of the session; its time covers planning, the
stages it writes and the transfer of its result. Inputs that queries share are built before.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalog import QUERIES  # noqa: E402
from checks.context import Inputs  # noqa: E402
from loglens.session import get_session  # noqa: E402

HEADLINE = [
    "A1_read_raw_log", "B6b_parse_lines", "B7_parse_report", "I2_mask_template", "I1_mine_templates",
    "I1b_mine_templates_prose", "D8_line_totals", "D11_top_templates", "D12_mode", "F2_logs_page", "F8_numbered_page",
    "B13_search_regex", "I3_window_features", "D1_event_counts", "C3_counts_with_meta", "I4_standard_scale",
    "I5_surrogate_scores", "I5_fit_isolation_forest", "I6_score_windows", "I8_predict", "I10_filter_gate",
    "D20_roc_auc", "D22_best_threshold", "I25_metrics_document", "I11_make_alerts", "C6_representative_lines",
    "I13_tfidf", "I15_dbscan_documents", "I15b_dbscan_alerts", "I16_dbscan_vectors", "I18_silhouette_documents",
    "I20_method_comparison", "D14_alert_summary", "D16_cluster_summary", "I21b_cluster_headers", "J_quality_verdict",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["D8_line_totals"](spark, sf_dir).collect()
    # Stages that several queries read are built before, so that no query is timed with another one's input.
    shared = Inputs(spark, sf_dir)
    for name in ("scores", "bare_alerts", "placed", "alerts", "both_ways"):
        getattr(shared, name)
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).toArrow()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
