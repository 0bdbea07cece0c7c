"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores.
Every query is executed completely into the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "A1_ordinal_histogram",
    "A10_weighted_index",
    "L4_index_with_interval",
    "A12_bootstrap_groups",
    "A13_bootstrap_by_cell",
    "A14_mean_and_median",
    "W1_percentile_rank_weights",
    "W2_survey_weights",
    "X4_index_per_source",
    "A20_recent_throughput",
    "A22_missing_manifest",
    "A23_phase_metrics",
    "A25_pooled_gradient",
    "A26_fixed_effects_test",
    "A27_scaling_test",
    "A28_marker_contrast_all_factors",
    "A29_cohens_kappa",
    "X2_benjamini_hochberg",
    "J1_panel_join",
    "J3_pending_anti_join",
    "J12_path_repair",
    "L6_shard_merge",
    "L7_progress_report",
    "L10_quality_gate",
    "W10_stratified_sample",
    "T6_failure_runs",
    "F1_consensus",
    "F10_prompt_text",
    "M3_classify_table",
    "T2_stream_upsert",
)


def main() -> None:
    from ordscope.session import get_spark
    from ordscope.workloads import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": "8" if cpus == "*" else cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small job so that session start-up is not charged to the first query.
    QUERIES["S1_parquet_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
