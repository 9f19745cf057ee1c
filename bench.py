"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores.  Every query is
written to the ``noop`` sink, so all rows and columns are computed and nothing is
collected.  One untimed pass over a small query starts the JVM; each query is then
run ``BENCH_RUNS`` times and its best time counts.
"""

from __future__ import annotations

import json
import os
import time

from clipweave.checks.queries import QUERIES
from clipweave.session import get_session

HEADLINE = [
    "clip_captions",
    "build_transcript",
    "transcript_stats",
    "candidate_spans",
    "best_span",
    "all_spans",
    "wrap_text",
    "motion_centroid",
    "smooth_track",
    "crop_per_frame",
    "active_speaker",
    "fill_track",
    "nms",
    "unique_faces",
    "static_crop",
    "choose_stream",
    "first_answer",
    "pending_items",
    "clip_manifest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = get_session(
        "clipweave-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["outcome_funnel"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
