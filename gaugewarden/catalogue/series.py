"""Row-order operators, splits and samples."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import labels, sampling, series
from ..schema import KEYS
from .base import query, r6

_W = "OVER (PARTITION BY station_id ORDER BY day)"


@query("lag_features", "SELECT station_id, day, " + r6(*(
    f"lag({p}, {i}) {_W} AS {p}_{i}" for p in fx.E_PARAMS for i in range(1, 6))) + " FROM e_wide", "e_wide")
def _(spark, sf_dir):
    wide = fx.e_wide(spark, sf_dir).select(*KEYS, *fx.E_PARAMS)
    return series.lag_features(wide, fx.E_PARAMS).drop(*fx.E_PARAMS)


@query("series_breaks", f"""WITH p AS (SELECT station_id, day, row_number() {_W} AS pos, CASE WHEN lag(day) {_W} = day - 1
    THEN 0 ELSE 1 END AS starts FROM e_wide),
    r AS (SELECT *, sum(starts) {_W} AS run FROM p),
    k AS (SELECT *, row_number() OVER (PARTITION BY station_id, run ORDER BY day) AS place FROM r)
    SELECT station_id, day, CAST(day - CAST(pos AS INTEGER) AS DATE) AS run_key FROM k WHERE place > 5""", "e_wide")
def _(spark, sf_dir):
    return series.series_breaks(fx.e_wide(spark, sf_dir).select(*KEYS))


def _window_columns(df, cols, n):
    """Window structs as plain columns, so that both engines can be compared."""
    return df.select(*KEYS, *[F.element_at("x", i)[c].alias(f"{c}_x{i}") for i in range(1, n + 1) for c in cols],
                     *[F.col("y")[c].alias(f"{c}_y") for c in cols])


def _sequence_sql(cols, n, extra=""):
    xs = r6(*(f"lag({c}, {n + 1 - i}) {_W} AS {c}_x{i}" for i in range(1, n + 1) for c in cols), *(f"{c} AS {c}_y" for c in cols))
    return (f"SELECT * EXCLUDE (pos, back) FROM (SELECT station_id, day, {xs}, row_number() {_W} AS pos, "
            f"lag(day, {n}) {_W} AS back FROM e_wide) WHERE pos > {n}{extra}")


@query("sequence_windows", _sequence_sql(fx.E_PARAMS, 5), "e_wide")
def _(spark, sf_dir):
    built = series.sequence_windows(fx.e_wide(spark, sf_dir), fx.E_PARAMS, 5)
    return _window_columns(built, fx.E_PARAMS, 5)


@query("sequence_windows_contiguous", _sequence_sql(fx.E_PARAMS, 3, " AND back = day - 3"), "e_wide")
def _(spark, sf_dir):
    built = series.sequence_windows(fx.e_wide(spark, sf_dir), fx.E_PARAMS, 3, contiguous=True)
    return _window_columns(built, fx.E_PARAMS, 3)


def _label_sql(source, by_cols, input_width, label_width, shift, cols, labels_):
    total = input_width + shift
    lag = lambda c, i: f"lag({c}, {total - i}) {_W}" if i < total else c
    ins = [f"{lag(c, i)} AS {c}_in{i}" for i in range(1, input_width + 1) for c in cols]
    outs = [f"{lag(c, total - label_width + i)} AS {c}_out{i}" for i in range(1, label_width + 1) for c in labels_]
    return (f"SELECT * EXCLUDE (pos) FROM (SELECT station_id, lag(day, {total - 1}) {_W} AS first_day, day AS last_day, "
            f"{r6(*ins, *outs)}, row_number() {_W} AS pos FROM {source}) WHERE pos >= {total}")


def _label_columns(df, input_width, label_width, cols, labels_):
    return df.select(
        "station_id", "first_day", "last_day",
        *[F.element_at("inputs", i)[c].alias(f"{c}_in{i}") for i in range(1, input_width + 1) for c in cols],
        *[F.element_at("labels", i)[c].alias(f"{c}_out{i}") for i in range(1, label_width + 1) for c in labels_])


@query("input_label_windows", _label_sql("e_wide", [], 6, 2, 2, fx.E_PARAMS, ["error"]), "e_wide")
def _(spark, sf_dir):
    built = series.input_label_windows(fx.e_wide(spark, sf_dir), fx.E_PARAMS, 6, 2, 2, ["error"])
    return _label_columns(built, 6, 2, fx.E_PARAMS, ["error"])


_GRID = """grid AS (SELECT s.station_id, d.day, {cols} FROM (SELECT DISTINCT station_id FROM {t}) s CROSS JOIN (
    SELECT CAST(unnest(generate_series((SELECT min(day) FROM {t}), (SELECT max(day) FROM {t}), INTERVAL {step})) AS DATE) AS day) d
    LEFT JOIN {t} w ON w.station_id = s.station_id AND w.day = d.day)"""


@query("densify_grid", "WITH " + _GRID.format(t="l_wide", cols="A, N, R", step="3 MONTH")
       + f" SELECT station_id, day, {r6('A', 'N', 'R')} FROM grid", "l_wide")
def _(spark, sf_dir):
    return series.densify_grid(fx.l_wide(spark, sf_dir).select(*KEYS, *fx.L_PARAMS), "3 MONTH")


@query("multi_series_windows", "WITH stats AS (SELECT station_id, " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in fx.E_PARAMS)
    + " FROM e_wide WHERE day <= DATE '2024-01-20' GROUP BY station_id), "
    + _GRID.format(t="e_wide", cols=", ".join(fx.E_PARAMS), step="1 DAY") + ", scaled AS (SELECT station_id, day, " + ", ".join(
        f"CASE WHEN s_{c} <> 0 THEN ({c} - m_{c}) / s_{c} END AS {c}" for c in fx.E_PARAMS)
    + " FROM grid LEFT JOIN stats USING (station_id)) " + _label_sql("scaled", [], 4, 3, 3, fx.E_PARAMS, ["click"]), "e_wide")
def _(spark, sf_dir):
    built = series.multi_series_windows(fx.e_wide(spark, sf_dir), ["click"], fx.E_PARAMS[1:], 4, 3, 3, normalise=True,
                                        train=F.col("day") <= "2024-01-20")
    return _label_columns(built, 4, 3, fx.E_PARAMS, ["click"])


_SPLIT = """CASE WHEN pos <= floor(n * CAST({0} AS DOUBLE)) THEN 'train' WHEN pos <= floor(n * CAST({1} AS DOUBLE)) THEN 'val'
    ELSE 'test' END AS split"""


@query("split_by_position", f"""SELECT station_id, day, pos, n, {_SPLIT.format(0.7, 0.9)} FROM (SELECT station_id, day,
    row_number() {_W} AS pos, count(*) OVER (PARTITION BY station_id) AS n FROM e_wide)""", "e_wide")
def _(spark, sf_dir):
    return series.split_by_position(fx.e_wide(spark, sf_dir).select(*KEYS))


@query("persistence_forecast", f"""SELECT station_id, day, {r6('view', 'p AS view_pred')} FROM (
    SELECT station_id, day, view, lag(view) {_W} AS p FROM e_wide) WHERE p IS NOT NULL""", "e_wide")
def _(spark, sf_dir):
    return series.persistence_forecast(fx.e_wide(spark, sf_dir), "view")


@query("forecast_errors", f"""SELECT count(view - p) AS rows, {r6('avg((view - p) * (view - p)) AS mse', 'avg(abs(view - p)) AS mae')}
    FROM (SELECT view, lag(view) {_W} AS p FROM e_wide) WHERE p IS NOT NULL""", "e_wide")
def _(spark, sf_dir):
    return series.forecast_errors(series.persistence_forecast(fx.e_wide(spark, sf_dir), "view"), "view")


@query("rank_within_group", """SELECT * FROM (SELECT station_id, row_id, round(value, 6) AS value, CAST(row_number() OVER (
    PARTITION BY station_id ORDER BY value, row_id) AS INTEGER) AS rank FROM e) WHERE rank <= 3""", "e")
def _(spark, sf_dir):
    rows = fx.e_long(spark, sf_dir).select("station_id", "row_id", "value")
    return series.rank_within_group(rows, ["station_id"], ["value", "row_id"], 3)


_HASH = lambda key: f"md5('42' || ':' || {key})"
_CELL = _HASH("CAST(station_id AS VARCHAR) || ':' || CAST(day AS VARCHAR)")
_SID = _HASH("CAST(station_id AS VARCHAR)")


@query("sample_stations", f"SELECT station_id FROM st ORDER BY {_SID} LIMIT 9", "st")
def _(spark, sf_dir):
    return sampling.sample_stations(fx.stations(spark, sf_dir), 9).select("station_id")


@query("sample_fraction", f"""SELECT station_id, day, anomaly FROM e_label
    WHERE substr({_CELL}, 1, 8) < '{int(0.2 * 16 ** 8):08x}' OR anomaly > 3""", "e_label")
def _(spark, sf_dir):
    rows = fx.e_label(spark, sf_dir).select(*KEYS, "anomaly")
    return sampling.sample_fraction(rows, 0.2, keep=F.col("anomaly") > 3)


@query("balanced_sample", f"""WITH r AS (SELECT doc_id, real, row_number() OVER (PARTITION BY real
    ORDER BY {_HASH('CAST(doc_id AS VARCHAR)')}) AS rn FROM lab)
    SELECT doc_id, real FROM r WHERE real = 1 OR rn <= (SELECT sum(real) FROM lab)""", "lab")
def _(spark, sf_dir):
    return sampling.balanced_sample(fx.verdicts(spark, sf_dir).select("doc_id", "real"), "real", key=["doc_id"])


@query("shuffle_rows", f"SELECT station_id, day FROM l_wide ORDER BY {_CELL}", "l_wide")
def _(spark, sf_dir):
    return sampling.shuffle_rows(fx.l_wide(spark, sf_dir).select(*KEYS))


_YEARS = f"""WITH k AS (SELECT station_id, row_number() OVER (ORDER BY {_SID}) AS rn, count(*) OVER () AS ids FROM (
    SELECT DISTINCT station_id FROM l_wide WHERE year(day) <= 2000)),
    s AS (SELECT l_wide.station_id, day, CASE WHEN year(day) > 2000 THEN 'test' WHEN year(day) = 2000
    OR rn <= round_even(ids * 0.1, 0) THEN 'val' ELSE 'train' END AS split FROM l_wide LEFT JOIN k USING (station_id)) """


def _year_split(spark, sf_dir):
    wide = fx.l_wide(spark, sf_dir).select(*KEYS)
    return sampling.split_by_year_station(wide, list(range(1995, 2000)), [2000])


@query("split_by_year_station", _YEARS + "SELECT station_id, day, split FROM s", "l_wide")
def _(spark, sf_dir):
    return _year_split(spark, sf_dir)


@query("split_test_stations", f"""WITH k AS (SELECT station_id, row_number() OVER (ORDER BY {_SID}) AS rn, count(*) OVER () AS ids
    FROM (SELECT DISTINCT station_id FROM l_wide))
    SELECT l_wide.station_id, day, CASE WHEN rn <= ids - ids * 9 // 10 OR year(day) = 2001 THEN 'test' ELSE 'train' END AS split
    FROM l_wide JOIN k USING (station_id)""", "l_wide")
def _(spark, sf_dir):
    return sampling.split_test_stations(fx.l_wide(spark, sf_dir).select(*KEYS), [2001])


@query("split_grid", _YEARS + "," + _GRID.format(t="s", cols="split", step="3 MONTH") + """
    SELECT station_id, day, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 WHEN 'test' THEN 3 ELSE 0 END AS part FROM grid""",
       "l_wide")
def _(spark, sf_dir):
    return sampling.split_grid(series.densify_grid(_year_split(spark, sf_dir), "3 MONTH"))


@query("season_lags", f"""SELECT station_id, day, CAST(dayofyear(day) AS INTEGER) AS jourjulien, {r6(f'lag(A) {_W} AS A_1')}
    FROM l_dense""", "l_dense")
def _(spark, sf_dir):
    dense = labels.add_season(fx.l_dense(spark, sf_dir).select(*KEYS, "A"))
    return series.lag_features(dense, ["A"], 1).select(*KEYS, "jourjulien", "A_1")
