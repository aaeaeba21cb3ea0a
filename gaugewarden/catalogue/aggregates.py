"""Aggregates, statistics and ordered reports."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import clean, labels, neighbours, profile, quantiles
from ..session import stage_table
from .base import E_COLS, L_COLS, LONG, query, r6

_FLAGGED = """WITH f AS (SELECT *, CASE WHEN raw_value IS NULL OR value <> raw_value THEN 1 ELSE 0 END AS correction,
    value - raw_value AS difference FROM e_clean) """


def _flagged(spark, sf_dir):
    return labels.correction_flag(fx.e_clean(spark, sf_dir))


for _unit, _suffix in (("year", ""), ("month", "_by_month")):
    @query(f"corrections_by_period_param{_suffix}", _FLAGGED + f"""SELECT CAST({_unit}(day) AS INTEGER) AS {_unit}, param,
        CAST(sum(correction) AS BIGINT) AS corrections,
        CAST(sum(CASE WHEN raw_value IS NULL THEN correction END) AS BIGINT) AS corrections_raw_unknown,
        CAST(sum(CASE WHEN raw_value IS NOT NULL THEN correction END) AS BIGINT) AS corrections_raw_known
        FROM f GROUP BY 1, 2""", "e_clean")
    def _(spark, sf_dir, unit=_unit):
        return profile.corrections_by_period_param(_flagged(spark, sf_dir), unit)

    @query(f"mean_by_period_param{_suffix}", f"""SELECT CAST({_unit}(day) AS INTEGER) AS {_unit}, param,
        round(avg(value), 6) AS mean_value FROM l GROUP BY 1, 2""", "l")
    def _(spark, sf_dir, unit=_unit):
        return profile.mean_by_period_param(fx.l_long(spark, sf_dir), unit)

    @query(f"relative_correction{_suffix}", _FLAGGED + f"""SELECT CAST({_unit}(day) AS INTEGER) AS {_unit}, param,
        {r6('avg(difference) AS mean_difference', 'avg(raw_value) AS mean_raw',
            'avg(difference) / avg(raw_value) AS relative_corr')} FROM f WHERE correction = 1 GROUP BY 1, 2""", "e_clean")
    def _(spark, sf_dir, unit=_unit):
        return profile.relative_correction(_flagged(spark, sf_dir), unit)


@query("correction_flag", """SELECT row_id, CASE WHEN raw_value IS NULL OR value <> raw_value THEN 1 ELSE 0 END AS correction,
    round(value - raw_value, 6) AS difference FROM e_clean""", "e_clean")
def _(spark, sf_dir):
    return _flagged(spark, sf_dir).select("row_id", "correction", "difference")


@query("correction_flag_known", """SELECT row_id, CASE WHEN abs(value - raw_value) > 0 THEN 1 ELSE 0 END AS correction,
    round(value - raw_value, 6) AS difference FROM e_clean""", "e_clean")
def _(spark, sf_dir):
    return labels.correction_flag(fx.e_clean(spark, sf_dir), null_is_diff=False).select(
        "row_id", "correction", "difference")


@query("distinct_years_per_station", "SELECT station_id, count(DISTINCT year(day)) AS years FROM l GROUP BY 1", "l")
def _(spark, sf_dir):
    return profile.distinct_years_per_station(fx.l_long(spark, sf_dir))


@query("stations_per_year", """SELECT CAST(year(day) AS INTEGER) AS year, count(DISTINCT station_id) AS stations
    FROM l GROUP BY 1""", "l")
def _(spark, sf_dir):
    return profile.stations_per_year(fx.l_long(spark, sf_dir))


@query("station_validity", "SELECT * FROM validity", "validity")
def _(spark, sf_dir):
    return profile.station_validity(fx.e_long(spark, sf_dir))


@query("daily_anomaly_rate", """SELECT day, CAST(sum(anomaly) AS BIGINT) AS anomalies, count(anomaly) AS rows,
    round(sum(anomaly) / count(anomaly), 6) AS rate FROM e_label GROUP BY day""", "e_label")
def _(spark, sf_dir):
    return profile.daily_anomaly_rate(fx.e_label(spark, sf_dir))


@query("null_profile", " UNION ALL ".join(
    f'SELECT \'{c}\' AS "column", count(*) - count({c}) AS nulls FROM e_wide' for c in E_COLS), "e_wide")
def _(spark, sf_dir):
    return profile.null_profile(fx.e_wide(spark, sf_dir), E_COLS)


@query("conditional_share", """SELECT count(*) AS rows,
    round(avg(CASE WHEN raw_value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS share FROM e WHERE status > 1""", "e")
def _(spark, sf_dir):
    return profile.conditional_share(fx.e_long(spark, sf_dir), F.col("raw_value").isNull(), F.col("status") > 1)


@query("value_counts", """SELECT status, count(*) AS count, round(count(*) / (SELECT count(*) FROM e
    WHERE raw_value IS NOT NULL), 6) AS share FROM e WHERE raw_value IS NOT NULL GROUP BY status""", "e")
def _(spark, sf_dir):
    return profile.value_counts(fx.e_long(spark, sf_dir).filter("raw_value IS NOT NULL"), "status", normalise=True)


@query("global_std", f"SELECT {r6(*(f'stddev_samp({c}) AS {c}' for c in E_COLS))} FROM e_wide", "e_wide")
def _(spark, sf_dir):
    return profile.global_std(fx.e_wide(spark, sf_dir), E_COLS)


@query("describe_table", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, {r6(
    f'avg({c}) AS mean', f'stddev_samp({c}) AS std', f'min({c}) AS min', f'max({c}) AS max',
    *(f'quantile_cont({c}, 0.{q}) AS q{q}' for q in (25, 50, 75)))} FROM l_wide""" for c in L_COLS).replace(
    "0.50)", "0.5)"), "l_wide")
def _(spark, sf_dir):
    return profile.describe_table(fx.l_wide(spark, sf_dir), L_COLS)


_QS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.995, 1.0]


@query("quantiles_exact", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({q} AS DOUBLE) AS q, round(quantile_cont({c}, {q}), 6) AS quantile FROM e_wide"""
    for c in E_COLS for q in _QS), "e_wide")
def _(spark, sf_dir):
    return quantiles.quantiles_exact(fx.e_wide(spark, sf_dir), E_COLS, _QS)


@query("quantiles_by_param", " UNION ALL ".join(
    f"""SELECT l_shipmode, CAST({q} AS DOUBLE) AS q, round(quantile_cont(price, {q}), 6) AS quantile FROM p GROUP BY 1"""
    for q in _QS).join(["WITH p AS (SELECT l_returnflag AS l_shipmode, l_extendedprice AS price FROM lineitem) ", ""]).replace(
    "l_shipmode", "param"))
def _(spark, sf_dir):
    prices = fx.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("param"), "l_extendedprice")
    return quantiles.exact_quantiles(prices, "l_extendedprice", _QS, ["param"])


@query("histogram_fixed_bins", """WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM e),
    h AS (SELECT CAST(least(floor((value - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, count(*) AS n FROM e, b GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS count FROM range(50) t(i) LEFT JOIN h ON h.bin = i""", "e")
def _(spark, sf_dir):
    return profile.histogram_fixed_bins(fx.e_long(spark, sf_dir), "value", 50)


@query("histogram_by_edges", """WITH h AS (SELECT CASE WHEN value < 5 THEN 0 WHEN value < 10 THEN 1 WHEN value < 15 THEN 2
    WHEN value < 20 THEN 3 WHEN value < 30 THEN 4 ELSE 5 END AS bin, count(*) AS n FROM e
    WHERE value >= 0 AND value <= 50 GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS count FROM range(6) t(i) LEFT JOIN h ON h.bin = i""", "e")
def _(spark, sf_dir):
    return profile.histogram_by_edges(fx.e_long(spark, sf_dir), F.col("value"), [0, 5, 10, 15, 20, 30, 50])


_EDGE = lambda i: f"(SELECT stddev_samp(click_origine) FROM e_wide) * CAST({i * 0.1!r} AS DOUBLE)"


@query("threshold_histogram", f"""WITH d AS (SELECT abs(click_origine - click) AS d FROM e_wide WHERE abs(click_origine - click) <> 0),
    h AS (SELECT {' + '.join(f'CASE WHEN d >= {_EDGE(i)} THEN 1 ELSE 0 END' for i in range(1, 10))} AS bin, count(*) AS n
    FROM d WHERE d <= {_EDGE(10)} GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS count FROM range(10) t(i) LEFT JOIN h ON h.bin = i""", "e_wide")
def _(spark, sf_dir):
    return profile.threshold_histogram(fx.e_wide(spark, sf_dir), "click")


_BOX = """WITH q AS (SELECT param, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
    quantile_cont(value, 0.75) AS q75 FROM {0} GROUP BY param),
    i AS (SELECT *, value >= q25 - 1.5 * (q75 - q25) AND value <= q75 + 1.5 * (q75 - q25) AS inside FROM {0} JOIN q USING (param))
    SELECT param, round(max(q25), 6) AS q25, round(max(q50), 6) AS q50, round(max(q75), 6) AS q75,
    round(min(CASE WHEN inside THEN value END), 6) AS whisker_low, round(max(CASE WHEN inside THEN value END), 6) AS whisker_high,
    count(*) - count(CASE WHEN inside THEN 1 END) AS outliers FROM i GROUP BY param"""


@query("box_stats", _BOX.format("e"), "e")
def _(spark, sf_dir):
    return profile.box_stats(fx.e_long(spark, sf_dir), "value", ["param"])


@query("box_stats_by_rank", _BOX.replace("param", "rank").replace("value", "km").format("near"), "near")
def _(spark, sf_dir):
    near = stage_table(neighbours.nearest_neighbours(fx.stations(spark, sf_dir)), "near")
    return profile.box_stats(near, "km", ["rank"])


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM l_wide"
    for i, a in enumerate(L_COLS) for b in L_COLS[i:]), "l_wide")
def _(spark, sf_dir):
    return profile.correlation_matrix(fx.l_wide(spark, sf_dir), L_COLS)


@query("pearson_test", """WITH p AS (SELECT corr(A, A_origine) AS r, count(*) AS n FROM l_wide
    WHERE A IS NOT NULL AND A_origine IS NOT NULL)
    SELECT round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 3) AS t FROM p""", "l_wide")
def _(spark, sf_dir):
    return profile.pearson_test(fx.l_wide(spark, sf_dir), "A", "A_origine").withColumn("t", F.round("t", 3))


@query("crosstab_labels", """SELECT real, CAST(sum(CASE WHEN pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pred_0,
    CAST(sum(pred) AS BIGINT) AS pred_1 FROM lab GROUP BY real""", "lab")
def _(spark, sf_dir):
    return profile.crosstab_labels(fx.verdicts(spark, sf_dir), "real", "pred")


@query("normalise_by_max_abs", """SELECT row_id, round(raw_value / max(abs(raw_value)) OVER (PARTITION BY param), 6)
    AS raw_value_normalised FROM e_clean""", "e_clean")
def _(spark, sf_dir):
    return profile.normalise_by_max_abs(fx.e_clean(spark, sf_dir), "raw_value", "param").select(
        "row_id", "raw_value_normalised")


@query("rmse_mae_by_param", " UNION ALL ".join(f"""SELECT '{p}' AS param, {r6(
    f'sqrt(avg(({p} - {p}_origine) * ({p} - {p}_origine))) AS rmse', f'avg(abs({p} - {p}_origine)) AS mae',
    f'quantile_cont(abs({p} - {p}_origine), 0.9) AS decile9')} FROM e_wide""" for p in fx.E_PARAMS), "e_wide")
def _(spark, sf_dir):
    return profile.rmse_mae_by_param(fx.e_wide(spark, sf_dir), fx.E_PARAMS, "_origine")


@query("cumulative_share", """WITH s AS (SELECT param, sum(value) / (SELECT sum(value) FROM e) AS share FROM e GROUP BY param)
    SELECT param, round(share, 6) AS share, round(sum(share) OVER (ORDER BY param), 6) AS cumulative,
    round((SELECT share FROM s ORDER BY param DESC LIMIT 1), 6) AS others FROM s""", "e")
def _(spark, sf_dir):
    long = fx.e_long(spark, sf_dir)
    total = long.agg(F.sum("value")).scalar()
    shares = long.groupBy("param").agg(F.sum("value").alias("s")).select("param", (F.col("s") / total).alias("share"))
    return profile.cumulative_share(shares, "share", "param", head=4)


@query("top_k_rows", f"SELECT {LONG} FROM e ORDER BY day, station_id, param, row_id LIMIT 50", "e")
def _(spark, sf_dir):
    return profile.top_k_rows(fx.e_long(spark, sf_dir), ["day", "station_id", "param", "row_id"], 50)


@query("sort_series", f"SELECT {LONG} FROM e_clean ORDER BY day, station_id, param, mode, row_id", "e_clean")
def _(spark, sf_dir):
    return profile.sort_series(fx.e_clean(spark, sf_dir), ["day", "station_id", "param", "mode", "row_id"])


@query("altitude_extremes", f"SELECT station_id, {r6('Altitude')} FROM st WHERE Altitude > 800", "st")
def _(spark, sf_dir):
    return clean.filter_extremes(fx.stations(spark, sf_dir), {"Altitude": (800, None)}).select("station_id", "Altitude")
