"""Write the executed (post-AQE) physical plans of headline queries.

Usage: python tools/explain_plans.py [sf_dir] > docs/PLANS.md
Each plan is condensed to its operator tree (expression ids stripped, long
lines cut) so exchanges, join strategies, partial aggregates and scan
schemas are easy to review.
"""

from __future__ import annotations

import os
import re
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)

from roadspeed.plans.queries import QUERIES  # noqa: E402
from roadspeed.session import build_session  # noqa: E402

NAMES = ["current_speed", "prediction_view", "answer_predict", "recent_history", "series_array",
         "register_segments", "attach_segment", "speed_record_projection", "denoise_series",
         "forecast_trend", "forecast_network", "geo_circle"]
KEEP = ("Exchange", "Join", "Scan", "WindowGroupLimit", "Aggregate", "Window", "Generate",
        "FlatMapGroupsInPandas", "Filter", "ReusedExchange", "AQEShuffleRead", "Union", "Expand")


def condensed(plan: str) -> list[str]:
    out = []
    for line in plan.split("\n"):
        body = line.lstrip(" :+-")
        op = re.sub(r"^\*\(\d+\) ", "", body).split(" ")[0]
        if not any(k in op for k in KEEP):
            continue
        body = re.sub(r"#\d+L?", "", body)
        body = re.sub(r", \[plan_id=\d+\]", "", body)
        out.append(line[: len(line) - len(line.lstrip(" :+-"))] + body[:200])
    return out


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 8)
    print(f"# Executed plans at {os.path.basename(sf)} (local[8], AQE on)\n")
    print("Generated by `tools/explain_plans.py`; operator trees only.\n")
    for name in NAMES:
        df = QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"## {name}\n\n```")
        print("\n".join(condensed(plan)))
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
