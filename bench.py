"""Time the headline queries, warm, and print one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "log_parse_fields",
    "log_mask",
    "template_match",
    "line_sequences",
    "sequences",
    "sequences_chunked",
    "interval_stats",
    "occurrence_matrix",
    "transition_contrast",
    "split_blocks",
    "windows_many_to_many",
    "window_scores",
    "block_scores_nll_max",
    "block_scores_nll_p95",
    "anomalous_blocks",
    "classification_summary",
    "threshold_sweep",
    "score_quantiles",
    "tabular_features",
    "history_stats_rollup",
    "rate_limit_audit",
    "request_outcomes",
)


def main() -> None:
    from eventloom.plans import catalog
    from eventloom.session import local_session

    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        build = catalog.QUERIES[name]
        best = float("inf")
        for _ in range(2):  # the first run warms up code and workers
            start = time.perf_counter()
            build(spark, FOLDER).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    with contextlib.suppress(Exception):
        spark.stop()


if __name__ == "__main__":
    main()
