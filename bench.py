"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tessera.plans import catalog  # noqa: E402
from tessera.session import local_session  # noqa: E402

HEADLINE = (
    "anchor_catalog", "window_tissue", "anchor_stratum_rollup", "resolution_plan",
    "sample_anchors", "context_tissue", "target_boxes_relaxed", "footprint_masks",
    "coverage_mismatch", "box_tokens", "random_token_split", "multiblock_masks",
    "knn_topk", "robustness_index", "silhouette_fixed", "adjusted_rand",
    "contingency_cramers_v", "splits_tabulated", "splits_custom", "sample_without_replacement",
    "throughput_window", "perf_window", "crossed_thresholds", "early_stop", "grad_norm_stats",
    "running_counters", "meter", "match_jobs", "dataset_profile", "stream_step_log",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["slide_build_summary"](spark, sf_dir).collect()  # start the executors
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
