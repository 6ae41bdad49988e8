"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the data and the cores.
``nested_fit_accuracy`` fits three models to every series and scores them on a year's hold-out,
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seriesloom import plans  # noqa: E402
from seriesloom.session import local_session  # noqa: E402

HEADLINE = [
    "nested_fit_accuracy",
    "nested_forecast",
    "customer_forecast",
    "scenario_forecast",
    "rollup_region",
    "agg_municipality",
    "src_csv_preamble",
    "rolling_mean",
    "calendar_features",
    "profile",
    "agg_median",
    "first_obs_per_period",
    "anomalies",
    "acf",
    "residual_tests",
    "nested_accuracy",
    "select_best",
    "ensemble_weighted",
    "prediction_interval",
    "fit_random_forest",
    "fit_boosted_trees",
    "global_forecast",
    "tune",
    "permutation_importance",
    "dist_dtw",
    "cluster_kmedoids_vectors",
    "cluster_kmeans",
    "cluster_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("OFF")
    queries = plans.queries()
    run = lambda name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    # start the JVM's and Python's workers outside the timings
    run("lag_features")
    run("pacf_12")
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
