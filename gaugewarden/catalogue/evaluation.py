"""Labels, metrics, votes and scaling."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import flag
from ..operators import clean, evaluate, labels, profile, scale
from ..plans import flows
from ..schema import KEYS, raw
from ..session import stage_table
from .base import L_COLS, L_WIDE, query, r6

_COUNTS = """CAST(sum(CASE WHEN {r} = 1 AND {p} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS "TP",
    CAST(sum(CASE WHEN {r} = 0 AND {p} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS "TN",
    CAST(sum(CASE WHEN {r} = 0 AND {p} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS "FP",
    CAST(sum(CASE WHEN {r} = 1 AND {p} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS "FN\""""
COUNTS = _COUNTS.format(r="real", p="pred")
_ratio = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a}) / ({b}) END"
METRICS = '"TP", "TN", "FP", "FN", ' + r6(
    _ratio("TP + TN", "TP + TN + FP + FN") + " AS accuracy", _ratio("TP", "(TP + FP)") + " AS precision",
    _ratio("TP", "(TP + FN)") + " AS recall", _ratio("2 * TP", "(2 * TP + FP + FN)") + " AS f1",
    f"({_ratio('TP', '(TP + FN)')} + {_ratio('TN', '(TN + FP)')}) / 2 AS roc",
    _ratio("1.0::DOUBLE * TP * TN - 1.0::DOUBLE * FP * FN",
           "(sqrt(TP + FP) * sqrt(TP + FN) * sqrt(TN + FP) * sqrt(TN + FN))") + " AS mcc")


@query("confusion_class", """SELECT doc_id, CASE WHEN real = 1 AND pred = 1 THEN 'TP' WHEN real = 1 THEN 'FN'
    WHEN pred = 1 THEN 'FP' ELSE 'TN' END AS outcome FROM lab""", "lab")
def _(spark, sf_dir):
    return evaluate.confusion_class(fx.verdicts(spark, sf_dir), "real", "pred").select("doc_id", "outcome")


@query("classification_metrics", f"WITH c AS (SELECT {COUNTS} FROM lab) SELECT {METRICS} FROM c", "lab")
def _(spark, sf_dir):
    return evaluate.classification_metrics(fx.verdicts(spark, sf_dir), "real", "pred")


@query("classification_metrics_by_group", f"""WITH c AS (SELECT lang, {COUNTS} FROM lab JOIN documents USING (doc_id)
    GROUP BY lang) SELECT lang, {METRICS} FROM c""", "lab")
def _(spark, sf_dir):
    langs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return evaluate.classification_metrics(fx.verdicts(spark, sf_dir).join(langs, "doc_id"), "real", "pred", ["lang"])


_CLASS = "SELECT {0} AS label, {h} AS h, {f} AS f, {m} AS m FROM c"


@query("class_report", f"WITH c AS (SELECT {COUNTS} FROM lab), r AS ("
       + _CLASS.format(0, h="TN", f="FN", m="FP") + " UNION ALL " + _CLASS.format(1, h="TP", f="FP", m="FN")
       + f") SELECT label, {r6('h / (h + f) AS precision', 'h / (h + m) AS recall', '2 * h / (2 * h + f + m) AS f1')}, "
         "h + m AS support FROM r", "lab")
def _(spark, sf_dir):
    return evaluate.class_report(fx.verdicts(spark, sf_dir), "real", "pred")


@query("metrics_per_param", "WITH c AS (" + " UNION ALL ".join(
    "SELECT '{0}' AS param, ".format(p) + _COUNTS.format(r=f"{p}_anomaly", p=f"hit_{p}") + " FROM (SELECT *, " + ", ".join(
        f"CASE WHEN abs({c}_difference) > 2 THEN 1 ELSE 0 END AS hit_{c}" for c in fx.L_PARAMS) + " FROM l_label)"
    for p in fx.L_PARAMS) + f") SELECT param, {METRICS} FROM c", "l_label")
def _(spark, sf_dir):
    hits = {f"{p}_anomaly_pred": flag(F.abs(f"{p}_difference") > 2) for p in fx.L_PARAMS}
    return flows.check(fx.l_label(spark, sf_dir).withColumns(hits)).select(
        "param", "TP", "TN", "FP", "FN", *evaluate.METRICS)


_SWEEP = [round(1 - 0.005 * i, 3) for i in range(21)]


@query("quantile_threshold_sweep", "WITH q AS (SELECT unnest({0}::DOUBLE[]) AS q, ".format(_SWEEP) + ", ".join(
    f"unnest(quantile_cont(abs({p}_difference), {_SWEEP})) AS t_{p}" for p in fx.L_PARAMS)
    + " FROM l_label WHERE year(day) <= 1998), s AS (SELECT q, CASE WHEN anomaly > 0 THEN 1 ELSE 0 END AS real, CASE WHEN "
    + " OR ".join(f"coalesce(abs({p}_difference) > t_{p}, false)" for p in fx.L_PARAMS)
    + f""" THEN 1 ELSE 0 END AS pred FROM l_label CROSS JOIN q WHERE year(day) > 1998),
    c AS (SELECT q, {COUNTS} FROM s GROUP BY q) SELECT q, {METRICS} FROM c""", "l_label")
def _(spark, sf_dir):
    rows = stage_table(fx.l_label(spark, sf_dir), "labelled").withColumns(
        {f"{p}_residual": F.abs(f"{p}_difference") for p in fx.L_PARAMS})
    early = F.year("day") <= 1998
    return evaluate.quantile_threshold_sweep(rows.filter(early), rows.filter(~early), fx.L_PARAMS, _SWEEP)


@query("detector_vote", """SELECT e_label.station_id, e_label.day, click_anomaly + error_anomaly + coalesce(missing, 0) AS votes
    FROM e_label LEFT JOIN (SELECT station_id, day, 1 AS missing FROM e_wide WHERE view IS NULL) m
    ON e_label.station_id = m.station_id AND e_label.day = m.day""", "e_label")
def _(spark, sf_dir):
    other = fx.e_wide(spark, sf_dir).filter("view IS NULL").select(*KEYS, F.lit(1).alias("missing"))
    joined = fx.e_label(spark, sf_dir).join(other, KEYS, "left")
    return labels.detector_vote(joined, ["click_anomaly", "error_anomaly", "missing"]).select(*KEYS, "votes")


_KEPT = {p: f"CASE WHEN anomaly > 0 THEN CASE WHEN abs({p} - {p}_origine) > {lim} THEN 1 ELSE 0 END ELSE {p}_anomaly END"
         for p, lim in zip(fx.E_FORECAST, (5, 10, 15, 20))}


@query("suppress_small_residuals", "SELECT station_id, day, " + ", ".join(
    f"{v} AS {p}_anomaly_pred" for p, v in _KEPT.items()) + ", CASE WHEN " + " + ".join(
    f"({v})" for v in _KEPT.values()) + " > 0 THEN 1 ELSE 0 END AS anomaly_pred FROM e_label", "e_label")
def _(spark, sf_dir):
    rows = fx.e_label(spark, sf_dir).withColumns({
        "anomaly_pred": flag(F.col("anomaly") > 0),
        **{f"{p}_pred": F.col(p) for p in fx.E_FORECAST}, **{f"{p}_anomaly_pred": F.col(f"{p}_anomaly") for p in fx.E_FORECAST}})
    kept = labels.suppress_small_residuals(rows, fx.E_FORECAST, [5, 10, 15, 20])
    return kept.select(*KEYS, *[f"{p}_anomaly_pred" for p in fx.E_FORECAST], "anomaly_pred")


@query("error_residual_extremes", "WITH s AS (SELECT *, CASE WHEN abs(A_difference) > 2 THEN 1 ELSE 0 END AS pred FROM l_label), "
       "o AS (SELECT *, CASE WHEN anomaly > 0 AND pred = 0 THEN 'FN' WHEN anomaly = 0 AND pred = 1 THEN 'FP' END AS outcome FROM s), "
       "u AS (" + " UNION ALL ".join(
           f"SELECT outcome, '{p}' AS param, abs({p}_origine - {p} * 1.02) AS residual, abs({p}_difference) AS correction FROM o"
           for p in fx.L_PARAMS) + f""") SELECT outcome, param, {r6('max(residual) AS max_residual',
           'max(correction) AS max_correction')} FROM u WHERE outcome IS NOT NULL GROUP BY 1, 2""", "l_label")
def _(spark, sf_dir):
    rows = fx.l_label(spark, sf_dir).withColumns({
        "anomaly_pred": flag(F.abs("A_difference") > 2), **{f"{p}_pred": F.col(p) * 1.02 for p in fx.L_PARAMS}})
    return evaluate.error_residual_extremes(rows, fx.L_PARAMS, "_origine")


_LIMITS = [0.5, 1.0, 1.5, 2.0]
_GRID = "WITH g AS (" + " UNION ALL ".join(
    f"SELECT CAST({t} AS DOUBLE) AS threshold, CASE WHEN anomaly > 0 THEN 1 ELSE 0 END AS real, "
    f"CASE WHEN abs(A_difference) > {t} THEN 1 ELSE 0 END AS pred FROM l_label" for t in _LIMITS) + \
    f"), c AS (SELECT threshold, {COUNTS} FROM g GROUP BY threshold), m AS (SELECT threshold, {METRICS} FROM c) "


def _grid(spark, sf_dir):
    cells = F.array(*[F.struct(F.lit(t).alias("threshold"), flag(F.abs("A_difference") > t).alias("pred")) for t in _LIMITS])
    rows = fx.l_label(spark, sf_dir).select(flag(F.col("anomaly") > 0).alias("real"), F.inline(cells))
    return evaluate.classification_metrics(rows, "real", "pred", ["threshold"])


@query("grid_report", _GRID + "SELECT *, " + r6(*(f'"{c}" / ("TP" + "TN" + "FP" + "FN") AS {c}_share' for c in (
    "TP", "TN", "FP", "FN"))) + " FROM m", "l_label")
def _(spark, sf_dir):
    return evaluate.grid_report(_grid(spark, sf_dir))


@query("select_best_candidate", _GRID + "SELECT * FROM m WHERE accuracy > 0.3 ORDER BY recall DESC, accuracy DESC LIMIT 1",
       "l_label")
def _(spark, sf_dir):
    return evaluate.select_best_candidate(_grid(spark, sf_dir), 0.3)


_FACTORS = [0.05, 0.1, 0.2, 0.4]


@query("threshold_variants", " UNION ALL ".join(
    f"""SELECT '{p}' AS param, CAST({f} AS DOUBLE) AS factor, CAST(sum(CASE WHEN abs({p}_origine - {p}) >
    (SELECT stddev_samp({p}_origine) FROM l_dense) * {f} THEN 1 ELSE 0 END) AS BIGINT) AS anomalies FROM l_dense"""
    for p in fx.L_PARAMS for f in _FACTORS), "l_dense")
def _(spark, sf_dir):
    return labels.threshold_variants(fx.l_dense(spark, sf_dir), fx.L_PARAMS, _FACTORS)


@query("fixed_threshold", """SELECT station_id, day, CASE WHEN abs(A_origine - A) > 2.5 THEN 1 ELSE 0 END AS A_anomaly
    FROM l_wide""", "l_wide")
def _(spark, sf_dir):
    return labels.fixed_threshold(fx.l_wide(spark, sf_dir), "A", 2.5).select(*KEYS, "A_anomaly")


@query("label_anomalies_dense", f"SELECT {L_WIDE}, {r6(*(f'{p}_difference' for p in fx.L_PARAMS))}, "
       + ", ".join(f"{p}_anomaly" for p in fx.L_PARAMS) + ", anomaly FROM l_label", "l_label")
def _(spark, sf_dir):
    return fx.l_label(spark, sf_dir)


@query("labelled_measurements", f"""SELECT {L_WIDE.replace('station_id', 'l_label.station_id')},
    {r6(*(f'{p}_difference' for p in fx.L_PARAMS))}, {', '.join(f'{p}_anomaly' for p in fx.L_PARAMS)}, anomaly,
    CAST(dayofyear(day) AS INTEGER) AS jourjulien, CAST(year(day) AS INTEGER) AS year,
    {r6('sin(2 * pi() * dayofyear(day) / 366) AS day_sin', 'cos(2 * pi() * dayofyear(day) / 366) AS day_cos',
        'Altitude', 'Lambert93x', 'Lambert93y')} FROM l_label JOIN st USING (station_id)""", "l_label", "st")
def _(spark, sf_dir):
    long = fx.l_long(spark, sf_dir).withColumn("mode", F.struct("mode", "row_id", "part"))
    wide = clean.dedup_and_pivot(clean.fill_raw_from_validated(long), fx.L_PARAMS, ["mode"])
    return flows.label_wide(wide, fx.stations(spark, sf_dir), fx.L_PARAMS)


def _scaled_sql(cols, expr, source, where=""):
    stat = lambda f, c: f"(SELECT {f}({c}) FROM {source}{where})"
    return f"SELECT station_id, day, {r6(*(f'({expr(c, stat)}) AS {c}' for c in cols))} FROM {source}"


@query("standardise", _scaled_sql(L_COLS, lambda c, s: f"({c} - {s('avg', c)}) / {s('stddev_pop', c)}", "l_dense"), "l_dense")
def _(spark, sf_dir):
    return scale.standardise(fx.l_dense(spark, sf_dir), L_COLS)


_EARLY = " WHERE year(day) <= 1998"


@query("zscore_train_stats", _scaled_sql(
    L_COLS, lambda c, s: f"({c} - {s('avg', c)}) / {s('stddev_samp', c)}", "l_dense", _EARLY), "l_dense")
def _(spark, sf_dir):
    return scale.zscore_train_stats(fx.l_dense(spark, sf_dir), L_COLS, F.year("day") <= 1998)


@query("zscore_by_station", "WITH s AS (SELECT station_id, " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in fx.L_PARAMS) + f" FROM l_dense{_EARLY} GROUP BY station_id) "
    "SELECT l_dense.station_id, day, " + r6(*(f"CASE WHEN d_{c} <> 0 THEN ({c} - m_{c}) / d_{c} END AS {c}" for c in fx.L_PARAMS))
    + " FROM l_dense LEFT JOIN s USING (station_id)", "l_dense")
def _(spark, sf_dir):
    dense = fx.l_dense(spark, sf_dir).select(*KEYS, *fx.L_PARAMS)
    return scale.zscore_train_stats(dense, fx.L_PARAMS, F.year("day") <= 1998, "station_id")


@query("minmax_scale", _scaled_sql(
    L_COLS, lambda c, s: f"({c} - {s('min', c)}) / ({s('max', c)} - {s('min', c)})", "l_dense", _EARLY), "l_dense")
def _(spark, sf_dir):
    return scale.minmax_scale(fx.l_dense(spark, sf_dir), L_COLS, F.year("day") <= 1998)


@query("minmax_inverse", f"SELECT {L_WIDE} FROM l_dense", "l_dense")
def _(spark, sf_dir):
    dense = fx.l_dense(spark, sf_dir)
    stats = scale.minmax_stats(dense.filter(F.year("day") <= 1998), L_COLS)
    return scale.minmax_inverse(scale.minmax_apply(dense, stats, L_COLS), stats, L_COLS)


@query("anomaly_share_by_param", "SELECT " + r6(*(f"avg({p}_anomaly) AS {p}" for p in fx.E_PARAMS)) + " FROM e_label", "e_label")
def _(spark, sf_dir):
    return fx.e_label(spark, sf_dir).agg(*[F.avg(f"{p}_anomaly").alias(p) for p in fx.E_PARAMS])


@query("corrected_raw_values", f"""SELECT station_id, day, {r6('click_origine', 'click_difference')} FROM e_label
    WHERE click_anomaly = 1 AND click_difference IS NOT NULL""", "e_label")
def _(spark, sf_dir):
    rows = fx.e_label(spark, sf_dir).filter((F.col("click_anomaly") == 1) & F.col("click_difference").isNotNull())
    return rows.select(*KEYS, raw("click"), "click_difference")


@query("correction_box_stats", """WITH b AS (SELECT click_difference AS value FROM e_label
    WHERE click_anomaly = 1 AND click_difference IS NOT NULL),
    q AS (SELECT quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM b),
    i AS (SELECT *, value >= q25 - 1.5 * (q75 - q25) AND value <= q75 + 1.5 * (q75 - q25) AS inside FROM b, q)
    SELECT round(max(q25), 6) AS q25, round(max(q50), 6) AS q50, round(max(q75), 6) AS q75,
    round(min(CASE WHEN inside THEN value END), 6) AS whisker_low, round(max(CASE WHEN inside THEN value END), 6) AS whisker_high,
    count(*) - count(CASE WHEN inside THEN 1 END) AS outliers FROM i""", "e_label")
def _(spark, sf_dir):
    return profile.box_stats(fx.e_label(spark, sf_dir).filter("click_anomaly = 1"), "click_difference")
