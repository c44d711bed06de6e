"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion into the no-op sink (all rows are computed, none
are collected).  The first pass warms the JVM; the second is timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from verimet.catalog import QUERIES  # noqa: E402
from verimet.session import build_session  # noqa: E402

HEADLINE = [
    "verify_station_fh", "station_scores", "mae_mse_division", "eval_rows", "confusion_sign", "hour_mae", "month_std",
    "box_month", "point_density", "bucket_err", "comparison_hour", "upsert_keep_last", "rs_table_1h", "rs_right_closed",
    "availability_median", "knn_clusters", "nearest_grid", "grid_interp", "nwp_month_job", "training_frame",
    "inference_frame", "win_arrays", "win_targets", "profiler_cube", "mc_decompose", "coverage", "calibrate",
    "fit_least_squares", "sweep_train_score",
]


def run(fn, spark, folder) -> float:
    started = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.log.level": "ERROR"},
    )
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    for name in names if os.path.isdir(small) else []:
        run(QUERIES[name], spark, small)
    times = {name: round(run(QUERIES[name], spark, folder), 3) for name in names}
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
