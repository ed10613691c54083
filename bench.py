"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from clickloom.plans.catalogue import QUERIES
from clickloom.session import get_session

HEADLINE = [
    "log_profile", "dedupe_log", "count_by_key", "count_by_pair", "count_by_bucket", "heat_distinct", "click_gaps",
    "first_last_flag", "remaining_clicks", "prev_next_gap", "history_cvr", "asof_mean", "rolling_history_rate",
    "yesterday_activity", "smoothed_cvr", "property_overlap", "log_loss", "score_correlation",
    "star_count_by_key", "star_asof_cvr", "final_stage_features",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["parse_category"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
