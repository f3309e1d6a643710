"""Benchmark: time the headline queries on $BENCH_SF_DIR (default sf0.1).

Each query is run to completion with the ``noop`` sink (full execution, no
driver collect). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roadspeed.plans.queries import QUERIES  # noqa: E402
from roadspeed.session import build_session  # noqa: E402

HEADLINE = [
    "current_speed", "latest_speed", "recent_history", "series_array", "prediction_view",
    "answer_predict", "list_segments", "search_segments", "geo_circle",
    "parse_results", "shape_hash", "register_segments", "register_incremental", "attach_segment",
    "speed_record_projection", "run_metrics",
    "pad_width", "instance_norm", "patches", "denoise_series",
    "forecast_persistence", "forecast_trend", "forecast_network",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    extra = {"spark.driver.memory": "16g"}
    if not os.environ.get("SPARK_CHECKPOINT_DIR"):
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="roadspeed-bench-")
    spark = build_session(f"local[{cpus}]", max(8, cpus), extra=extra)
    times = {}
    # warm-up: JIT and file listing caches, not timed
    QUERIES["latest_speed"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    tag = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf = float(tag)
    except ValueError:
        sf = tag
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
