"""Projections, filters, cleaning, reshaping, joins and scalar functions."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import day_part, name_prefix, round_to_day, row_sum
from ..operators import clean, joins, labels, profile, sampling, series
from .base import E_COLS, E_LABEL, E_WIDE, L_WIDE, LONG, query, r6


@query("filter_params", f"SELECT {LONG} FROM e WHERE param IN ('click', 'view')", "e")
def _(spark, sf_dir):
    return clean.filter_params(fx.e_long(spark, sf_dir), ["click", "view"])


@query("exclude_param", f"SELECT {LONG} FROM e WHERE param <> 'error'", "e")
def _(spark, sf_dir):
    return clean.exclude_param(fx.e_long(spark, sf_dir), "error")


@query("filter_period", f"SELECT {L_WIDE} FROM l_wide WHERE year(day) IN (1996, 1997, 1998)", "l_wide")
def _(spark, sf_dir):
    return clean.filter_period(fx.l_wide(spark, sf_dir), 1996, 3)


@query("filter_station", f"SELECT {L_WIDE} FROM l_wide WHERE station_id = 3 AND year(day) = 1997", "l_wide")
def _(spark, sf_dir):
    return clean.filter_station(fx.l_wide(spark, sf_dir), 3, 1997)


@query("project_columns", f"SELECT station_id, day, {r6('click AS click_corrige', 'click_origine AS click')} FROM e_wide",
       "e_wide")
def _(spark, sf_dir):
    swapped = clean.swap_raw_and_validated(fx.e_wide(spark, sf_dir), ["click"])
    return clean.project_columns(swapped, ["station_id", "day", "click_corrige", "click"])


@query("fill_raw_from_validated", "SELECT row_id, round(coalesce(raw_value, value), 6) AS raw_value FROM e", "e")
def _(spark, sf_dir):
    return clean.fill_raw_from_validated(fx.e_long(spark, sf_dir)).select("row_id", "raw_value")


@query("null_sentinel", "SELECT row_id, round(nullif(coalesce(raw_value, value), -999), 6) AS raw_value FROM e", "e")
def _(spark, sf_dir):
    return clean.null_sentinel(clean.fill_raw_from_validated(fx.e_long(spark, sf_dir))).select("row_id", "raw_value")


@query("fill_mode_priority", "SELECT row_id, coalesce(mode, 4) AS mode FROM e", "e")
def _(spark, sf_dir):
    return clean.fill_mode_priority(fx.e_long(spark, sf_dir)).select("row_id", "mode")


@query("drop_incomplete_rows", f"SELECT {L_WIDE} FROM l_wide WHERE A IS NOT NULL AND N IS NOT NULL AND R IS NOT NULL",
       "l_wide")
def _(spark, sf_dir):
    return clean.drop_incomplete_rows(fx.l_wide(spark, sf_dir), fx.L_PARAMS)


@query("filter_extremes", f"SELECT {L_WIDE} FROM l_wide WHERE A > 40 AND N < 25 AND R > 0 AND R < 15.5", "l_wide")
def _(spark, sf_dir):
    return clean.filter_extremes(fx.l_wide(spark, sf_dir), {"A": (40, None), "N": (None, 25), "R": (0, 15.5)})


@query("stations_active_on", """SELECT station_id, first_day, last_day FROM validity JOIN st USING (station_id)
    WHERE DATE '2024-01-02' BETWEEN first_day AND last_day""", "validity", "st")
def _(spark, sf_dir):
    dated = joins.join_validity_interval(fx.stations(spark, sf_dir), fx.e_long(spark, sf_dir))
    return clean.stations_active_on(dated, "2024-01-02").select("station_id", "first_day", "last_day")


@query("stations_open", f"SELECT station_id, {r6('Altitude')} FROM st WHERE in_service = 'O'", "st")
def _(spark, sf_dir):
    return clean.stations_open(fx.stations(spark, sf_dir)).select("station_id", "Altitude")


@query("derive_department", "SELECT station_id, station_id // 100 AS department, count(*) AS rows FROM e GROUP BY 1, 2", "e")
def _(spark, sf_dir):
    return clean.derive_department(fx.e_long(spark, sf_dir)).groupBy("station_id", "department").agg(
        F.count("*").alias("rows"))


@query("binarise_anomaly", """SELECT station_id, day, CASE WHEN anomaly > 0 THEN 1 ELSE 0 END AS any_param,
    CASE WHEN anomaly > 1 THEN 1 ELSE 0 END AS two_params, CASE WHEN anomaly > 0 THEN -1 ELSE 1 END AS signed
    FROM e_label""", "e_label")
def _(spark, sf_dir):
    df = fx.e_label(spark, sf_dir).select("station_id", "day", *[F.col("anomaly").alias(c) for c in (
        "any_param", "two_params", "signed")])
    df = clean.binarise_anomaly(clean.binarise_anomaly(df, 1, "any_param"), 2, "two_params")
    return clean.binarise_anomaly(df, 1, "signed", signed=True)


@query("rain_classes", """SELECT station_id, day, round(click, 6) AS click, CASE
    WHEN click > -1 AND click <= 0 THEN 'paspluie' WHEN click > 0 AND click <= 0.5 THEN 'tresfaible'
    WHEN click > 0.5 AND click <= 5 THEN 'faible' WHEN click > 5 AND click <= 15 THEN 'moyen'
    WHEN click > 15 AND click <= 50 THEN 'fort' WHEN click > 50 AND click <= 500 THEN 'extreme' END AS click_class,
    CASE WHEN click > 0 THEN 1 ELSE 0 END AS click_present FROM e_wide""", "e_wide")
def _(spark, sf_dir):
    return clean.rain_classes(fx.e_wide(spark, sf_dir).select("station_id", "day", "click"), "click")


@query("dedup_by_priority", f"SELECT {LONG} FROM e_dedup", "e_dedup")
def _(spark, sf_dir):
    return clean.dedup_by_priority(fx.e_clean(spark, sf_dir))


@query("distinct_keys", "SELECT DISTINCT station_id, param FROM e", "e")
def _(spark, sf_dir):
    return clean.distinct_keys(fx.e_long(spark, sf_dir), ["station_id", "param"])


@query("pivot_long_to_wide", f"SELECT {E_WIDE} FROM e_wide", "e_wide")
def _(spark, sf_dir):
    return clean.pivot_long_to_wide(clean.dedup_by_priority(fx.e_clean(spark, sf_dir)), fx.E_PARAMS)


@query("dedup_and_pivot", f"SELECT {L_WIDE} FROM l_wide", "l_wide")
def _(spark, sf_dir):
    return fx.l_wide(spark, sf_dir)


@query("unpivot_wide_to_long", " UNION ALL ".join(
    f"SELECT station_id, day, '{p}' AS param, round({p}, 6) AS value FROM e_wide" for p in fx.E_PARAMS), "e_wide")
def _(spark, sf_dir):
    return clean.unpivot_wide_to_long(fx.e_wide(spark, sf_dir), ["station_id", "day"], fx.E_PARAMS)


@query("presence_matrix", """SELECT s.station_id, d.day, CASE WHEN w.click IS NULL THEN 0 ELSE 1 END AS present
    FROM (SELECT DISTINCT station_id FROM e_wide) s CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(day)
    FROM e_wide), (SELECT max(day) FROM e_wide), INTERVAL 1 DAY)) AS DATE) AS day) d
    LEFT JOIN e_wide w ON w.station_id = s.station_id AND w.day = d.day""", "e_wide")
def _(spark, sf_dir):
    return sampling.presence_matrix(series.densify_grid(fx.e_wide(spark, sf_dir)), "click")


@query("union_all", """SELECT param, count(*) AS rows, round(sum(value), 6) AS total FROM (
    SELECT param, value FROM e UNION ALL SELECT param, value FROM l) GROUP BY param""", "e", "l")
def _(spark, sf_dir):
    both = clean.union_all(*[t(spark, sf_dir).select("param", "value") for t in (fx.e_long, fx.l_long)])
    return both.groupBy("param").agg(F.count("*").alias("rows"), F.sum("value").alias("total"))


@query("attach_columns", f"""SELECT e_wide.station_id, e_wide.day, {r6('e_wide.click AS click')}, anomaly
    FROM e_wide LEFT JOIN e_label ON e_wide.station_id = e_label.station_id AND e_wide.day = e_label.day""", "e_label")
def _(spark, sf_dir):
    flags = fx.e_label(spark, sf_dir).select("station_id", "day", "anomaly")
    return clean.attach_columns(fx.e_wide(spark, sf_dir).select("station_id", "day", "click"), flags)


@query("semi_anti_membership", """SELECT vec_id AS station_id, label FROM embeddings
    WHERE vec_id IN (SELECT user_id FROM events)""")
def _(spark, sf_dir):
    every = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("station_id"), "label")
    return clean.semi_anti_membership(every, fx.e_long(spark, sf_dir))


@query("anti_membership", """SELECT vec_id AS station_id, label FROM embeddings
    WHERE vec_id NOT IN (SELECT user_id FROM events)""")
def _(spark, sf_dir):
    every = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("station_id"), "label")
    return clean.semi_anti_membership(every, fx.e_long(spark, sf_dir), keep=False)


@query("drop_gappy_stations", f"SELECT {L_WIDE} FROM l_dense", "l_dense")
def _(spark, sf_dir):
    return fx.l_dense(spark, sf_dir)


@query("join_station_attrs", f"""SELECT e_wide.station_id, day, {r6('click', 'Altitude', 'Lambert93x', 'Lambert93y')}
    FROM e_wide JOIN st USING (station_id)""", "e_wide", "st")
def _(spark, sf_dir):
    wide = fx.e_wide(spark, sf_dir).select("station_id", "day", "click")
    return joins.join_station_attrs(wide, fx.stations(spark, sf_dir), ["Altitude", "Lambert93x", "Lambert93y"])


@query("join_spatial_left", f"""SELECT l_wide.station_id, day, {r6('A', 'Lambert93x', 'Lambert93y', 'Altitude')},
    region AS cluster FROM l_wide LEFT JOIN st USING (station_id)""", "l_wide", "st")
def _(spark, sf_dir):
    wide = fx.l_wide(spark, sf_dir).select("station_id", "day", "A", F.lit(0.0).alias("Altitude"))
    return joins.join_spatial_left(wide, fx.stations(spark, sf_dir).withColumnRenamed("region", "cluster"))


@query("join_detector_results", """SELECT e_label.station_id, e_label.day, anomaly, missing FROM e_label
    LEFT JOIN (SELECT station_id, day, 1 AS missing FROM e_wide WHERE view IS NULL) m
    ON e_label.station_id = m.station_id AND e_label.day = m.day""", "e_label")
def _(spark, sf_dir):
    other = fx.e_wide(spark, sf_dir).filter("view IS NULL").select("station_id", "day", F.lit(1).alias("missing"))
    return joins.join_detector_results(fx.e_label(spark, sf_dir).select("station_id", "day", "anomaly"), other)


@query("join_on_common_columns", """SELECT param, CAST(year(day) AS INTEGER) AS year, round(avg(value), 6) AS mean_value,
    count(*) AS rows FROM l GROUP BY 1, 2""", "l")
def _(spark, sf_dir):
    long = fx.l_long(spark, sf_dir)
    counts = long.groupBy(F.year("day").alias("year"), "param").agg(F.count("*").alias("rows"))
    return joins.join_on_common_columns(profile.mean_by_period_param(long, "year"), counts)


@query("join_validity_interval", f"SELECT station_id, {r6('Altitude')}, first_day, last_day FROM st JOIN validity USING (station_id)",
       "st", "validity")
def _(spark, sf_dir):
    return joins.join_validity_interval(fx.stations(spark, sf_dir).select("station_id", "Altitude"),
                                        fx.e_long(spark, sf_dir))


@query("date_functions", """SELECT event_id, CAST(ts AS DATE) AS day, CAST(year(ts) AS INTEGER) AS year,
    CAST(month(ts) AS INTEGER) AS month, CAST(dayofyear(ts) AS INTEGER) AS doy,
    CAST(CAST(ts AS DATE) + 3 AS DATE) AS later, CAST(CAST(ts AS DATE) - 1 AS DATE) AS earlier,
    CAST(ts + INTERVAL 12 HOUR AS DATE) AS nearest, CAST(ts AS DATE) AS text_day FROM events""")
def _(spark, sf_dir):
    ts = F.col("ts")
    return fx.table(spark, sf_dir, "events").select(
        "event_id", F.to_date(ts).alias("day"), F.year(ts).alias("year"), F.month(ts).alias("month"),
        F.dayofyear(ts).alias("doy"), F.date_add(ts, 3).alias("later"), F.date_sub(ts, 1).alias("earlier"),
        round_to_day(ts).alias("nearest"), day_part(F.date_format(ts, "yyyy-MM-dd HH")).alias("text_day"))


@query("seasonal_encoding", f"""SELECT station_id, day, CAST(dayofyear(day) AS INTEGER) AS jourjulien,
    {r6('sin(2 * pi() * dayofyear(day) / 366) AS day_sin', 'cos(2 * pi() * dayofyear(day) / 366) AS day_cos')},
    CAST(year(day) AS INTEGER) AS year FROM l_wide""", "l_wide")
def _(spark, sf_dir):
    return labels.add_season(fx.l_wide(spark, sf_dir).select("station_id", "day"))


@query("math_functions", f"""SELECT station_id, day, {r6('abs(click_origine - click) AS gap',
    'sqrt(click) AS root', 'click * click AS square',
    'coalesce(click, 0) + coalesce(error, 0) + coalesce(view, 0) AS total')}, station_id // 100 AS hundred
    FROM e_wide""", "e_wide")
def _(spark, sf_dir):
    return fx.e_wide(spark, sf_dir).select(
        "station_id", "day", F.abs(F.col("click_origine") - F.col("click")).alias("gap"), F.sqrt("click").alias("root"),
        (F.col("click") * F.col("click")).alias("square"), row_sum(["click", "error", "view"]).alias("total"),
        F.floor(F.col("station_id") / 100).alias("hundred"))


@query("conditional_functions", """SELECT row_id, CASE WHEN raw_value IS NULL THEN 1 ELSE 0 END AS unknown,
    coalesce(mode, 4) AS mode, CASE WHEN param IN ('click', 'view') THEN 'seen' ELSE 'done' END AS family FROM e""", "e")
def _(spark, sf_dir):
    return fx.e_long(spark, sf_dir).select(
        "row_id", F.when(F.col("raw_value").isNull(), 1).otherwise(0).alias("unknown"),
        F.coalesce("mode", F.lit(4)).alias("mode"),
        F.when(F.col("param").isin("click", "view"), "seen").otherwise("done").alias("family"))


@query("string_functions", """SELECT column_name AS name, split_part(column_name, '_', 1) AS prefix,
    replace(column_name, '_origine', '') AS plain, CAST(sum(n) AS BIGINT) AS known FROM (
    """ + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n FROM e_wide" for c in E_COLS)
       + ") GROUP BY column_name", "e_wide")
def _(spark, sf_dir):
    known = fx.e_wide(spark, sf_dir).agg(*[F.count(c).alias(c) for c in E_COLS]).unpivot([], E_COLS, "name", "known")
    return known.withColumns({"prefix": name_prefix(F.col("name")), "plain": F.replace("name", F.lit("_origine"), F.lit(""))})


@query("array_functions", f"""SELECT vec_id, CAST(step AS INTEGER) AS step, {r6('list_sum(v) * 2 AS doubled', 'v[1] AS first', 'v[8] AS last')}
    FROM (SELECT vec_id, step, list_transform(embedding[step * 8 + 1:step * 8 + 8], lambda e: CAST(e AS DOUBLE)) AS v
    FROM (SELECT *, unnest(range(len(embedding) // 8)) AS step FROM embeddings))""")
def _(spark, sf_dir):
    """All values of each array as stacked windows of eight."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    windows = F.transform(F.sequence(F.lit(0), (F.size(v) / 8).cast("int") - 1), lambda i: F.slice(v, i * 8 + 1, 8))
    doubled = F.aggregate(F.transform("w", lambda x: x * 2), F.lit(0.0), lambda a, x: a + x)
    stacked = fx.table(spark, sf_dir, "embeddings").filter(F.size("embedding") >= 8).select("vec_id", F.posexplode(windows).alias("step", "w"))
    return stacked.select("vec_id", "step", doubled.alias("doubled"), F.col("w")[0].alias("first"), F.element_at("w", -1).alias("last"))


@query("label_anomalies", f"SELECT {E_LABEL} FROM e_label", "e_label")
def _(spark, sf_dir):
    return fx.e_label(spark, sf_dir)
