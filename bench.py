"""Headline queries, wall seconds each (plan building included), warm, median of three, as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from quire.plans import registry
from quire.session import build_session

HEADLINE = (
    "segments_by_language",
    "segment_documents",
    "pack_segments",
    "html_blocks",
    "md_classify",
    "verify_structure",
    "dedupe_sentences",
    "split_oversized",
    "transition_jobs",
    "complete_segments",
    "partial_preview",
    "render_text",
    "recent_log",
    "pdf_nodes",
    "docx_nodes",
    "translate_segments",
    "live_segment_status",
    "rate_limit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session("quire-bench", f"local[{cpus}]", int(cpus), input_tasks=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(repeats + 1):  # the first run warms the JVM up
            t0 = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "sum of headline query medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "master": f"local[{cpus}]",
                "shuffle_partitions": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
