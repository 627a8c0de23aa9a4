"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed fully (``noop`` sink: every row is produced, nothing is
collected), once to warm up and then ``BENCH_REPEAT`` times; the reported
figure per query is the median.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.plans import catalog  # noqa: E402
from quarry.session import local_session  # noqa: E402

HEADLINE = [
    "count_plot", "count_plot_binned", "mean_plot", "box_plot", "scatter_plot",
    "group_stats", "grouped_average_numeric", "column_summary",
    "count_plot_text", "grouped_average_text", "tfidf",
    "stratified_kfold", "cv_scores", "regression_metrics", "classification_metrics",
    "roc_curve", "confusion_matrix", "scale_robust", "one_hot", "tfidf_pipeline",
    "linear_predictions", "gnb_predictions", "prediction_reasons", "dependence_table", "cv_trial",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="quarry-bench")
    qs = catalog.queries()
    times = {}
    for name in names:
        fn = qs[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
