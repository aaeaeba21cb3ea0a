"""Wall time of the headline queries; prints one JSON line.

Every query is written to Spark's ``noop`` sink, so all columns of all rows
are computed and nothing is moved to the driver. A first run of the flagship
query warms up the session and is not counted.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugewarden.catalogue import QUERIES  # noqa: E402
from gaugewarden.session import local_session  # noqa: E402

HEADLINE = [
    "daily_anomaly_rate", "label_anomalies", "dedup_and_pivot", "labelled_measurements", "pivot_long_to_wide",
    "corrections_by_period_param", "describe_table", "quantiles_by_param", "box_stats", "correlation_matrix",
    "normalise_by_max_abs", "lag_features", "series_breaks", "sequence_windows", "input_label_windows", "split_by_position",
    "nearest_neighbours", "neighbour_lag_features", "active_neighbours_daily", "standardise", "minmax_scale",
    "balanced_sample", "quantile_threshold_sweep", "density_noise_grid", "density_noise_features", "isolation_forest",
    "isolation_forest_by_param", "reconstruction_residual", "linear_forecast", "cluster_stations",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 8, os.environ.get("BENCH_MEMORY", "16g"), tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    QUERIES["daily_anomaly_rate"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
