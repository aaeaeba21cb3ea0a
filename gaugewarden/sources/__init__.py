from .readers import scan_measurements_csv, scan_results_csv, scan_stations_csv, sql_over_file
from .versions import drop_versions
from .writers import append_run_log, load_fitted_stats, read_run_log, save_fitted_stats, write_feature_matrix, write_partitioned

__all__ = [
    "append_run_log", "drop_versions", "load_fitted_stats", "read_run_log", "save_fitted_stats", "scan_measurements_csv",
    "scan_results_csv", "scan_stations_csv", "sql_over_file", "write_feature_matrix", "write_partitioned",
]
