"""Scans and sinks: every one writes a given table in the wanted form and reads it back."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import scale
from ..schema import MEASUREMENTS
from ..session import scratch_path
from ..sources import (append_run_log, load_fitted_stats, read_run_log, save_fitted_stats, scan_measurements_csv, scan_results_csv,
                       sql_over_file, write_feature_matrix, write_partitioned)
from .base import L_COLS, query, r6


@query("scan_measurements_csv", f"SELECT station_id, param, day, {r6('value', 'raw_value')}, status, mode FROM e", "e")
def _(spark, sf_dir):
    path = scratch_path(spark, "measurements") + ".csv"
    fx.e_long(spark, sf_dir).select(*MEASUREMENTS.fieldNames()).write.csv(path, sep=";", header=True)
    return scan_measurements_csv(spark, path).withColumn("station_id", F.col("station_id").cast("long"))


@query("sql_over_file", """SELECT user_id AS station_id, count(*) AS measurements FROM events
    WHERE event_type IN ('click', 'view') GROUP BY user_id""")
def _(spark, sf_dir):
    return sql_over_file(spark, f"{sf_dir}/events.parquet", """
        SELECT user_id AS station_id, count(*) AS measurements FROM {measurements}
        WHERE event_type IN ('click', 'view') GROUP BY user_id""")


@query("write_partitioned", """SELECT CAST(1995 + (year(day) - 1995) // 3 * 3 AS VARCHAR) || '-'
    || CAST(1997 + (year(day) - 1995) // 3 * 3 AS VARCHAR) AS period, count(*) AS rows, round(sum(value), 6) AS total
    FROM l GROUP BY 1""", "l")
def _(spark, sf_dir):
    path = scratch_path(spark, "periods")
    write_partitioned(fx.l_long(spark, sf_dir), path, 3, 1995)
    return spark.read.parquet(path).groupBy("period").agg(F.count("*").alias("rows"), F.sum("value").alias("total"))


@query("scan_results_csv", "SELECT station_id, day, anomaly, round(click, 6) AS click FROM e_label", "e_label")
def _(spark, sf_dir):
    path = scratch_path(spark, "results")
    fx.e_label(spark, sf_dir).select("station_id", "day", "anomaly", "click").write.csv(path, header=True)
    return scan_results_csv(spark, path, "station_id long, day date, anomaly int, click double")


@query("write_feature_matrix", "SELECT station_id, day, "
       + r6(*(f"CAST({c} AS DOUBLE) AS f{i}" for i, c in enumerate(L_COLS))) + " FROM l_dense", "l_dense")
def _(spark, sf_dir):
    path = scratch_path(spark, "matrix")
    write_feature_matrix(fx.l_dense(spark, sf_dir), L_COLS, path, ["station_id", "day"])
    return spark.read.parquet(path).select(
        "station_id", "day", *[F.col("features")[i].alias(f"f{i}") for i in range(len(L_COLS))])


_SCALED = ", ".join(f"({c} - (SELECT min({c}) FROM l_dense)) / ((SELECT max({c}) FROM l_dense) - "
                    f"(SELECT min({c}) FROM l_dense)) AS {c}" for c in fx.L_PARAMS)


@query("save_fitted_stats", f"SELECT station_id, day, {r6(*fx.L_PARAMS)} FROM "
       f"(SELECT station_id, day, {_SCALED} FROM l_dense)", "l_dense")
def _(spark, sf_dir):
    path = scratch_path(spark, "stats")
    dense = fx.l_dense(spark, sf_dir).select("station_id", "day", *fx.L_PARAMS)
    save_fitted_stats(scale.minmax_stats(dense, fx.L_PARAMS), path)
    return scale.minmax_apply(dense, load_fitted_stats(spark, path), fx.L_PARAMS)


@query("append_run_log", """SELECT 'quality' AS candidate, count(*) AS rows, CAST(sum(real) AS BIGINT) AS hits FROM lab
    UNION ALL SELECT 'toxic', count(*), CAST(sum(pred) AS BIGINT) FROM lab""", "lab")
def _(spark, sf_dir):
    path = scratch_path(spark, "log")
    lab = fx.verdicts(spark, sf_dir)
    for candidate, col in (("quality", "real"), ("toxic", "pred"), ("quality", "real")):  # the first run is repeated
        record = lab.agg(F.count("*").alias("rows"), F.sum(col).alias("hits")).withColumn("candidate", F.lit(candidate))
        append_run_log(record, path)
    return read_run_log(spark, path, ["candidate"]).select("candidate", "rows", "hits")
