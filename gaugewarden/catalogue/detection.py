"""Detectors. Those that are random or iterative have no SQL to agree with; tests check their properties."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..detectors import cluster, density, isoforest, residual
from ..operators import neighbours, profile, scale, series
from ..plans import flows
from ..schema import KEYS, raw
from ..session import stage_table
from .base import query, r6, solve_sql
from .evaluation import COUNTS, METRICS

_MEAN = lambda c, t: f"(({c} - (SELECT avg({c}) FROM {t})) / (SELECT stddev_pop({c}) FROM {t}))"
_PT = "z AS MATERIALIZED (SELECT vec_id, " + ", ".join(f"{_MEAN(c, 'pt')} AS {c}" for c in fx.POINT) + " FROM pt)"


def _near_sql(key, cols, eps, name):
    square = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in cols)
    a, b = (", ".join(f"{t}.{k} AS {t}_{k}" for k in key) for t in "ab")
    same = " AND ".join
    return (f"{name} AS MATERIALIZED (SELECT {a}, {b} FROM z a JOIN z b ON {square} <= {eps} * {eps}), "
            f"{name}_n AS MATERIALIZED (SELECT {', '.join(f'a_{k}' for k in key)}, count(*) AS n FROM {name} GROUP BY ALL), "
            f"{name}_r AS MATERIALIZED (SELECT {', '.join(f'p.a_{k} AS {k}' for k in key)}, max(n) AS reach FROM {name} p "
            f"JOIN {name}_n q ON {same(f'p.b_{k} = q.a_{k}' for k in key)} GROUP BY ALL)")


def _points(spark, sf_dir):
    return stage_table(scale.standardise(fx.points(spark, sf_dir), fx.POINT), "standardised")


@query("density_noise", f"WITH {_PT}, {_near_sql(['vec_id'], fx.POINT, 9.7, 'p')} "
       "SELECT vec_id, CASE WHEN reach < 8 THEN 1 ELSE 0 END AS noise FROM p_r", "pt")
def _(spark, sf_dir):
    return density.density_noise(_points(spark, sf_dir), fx.POINT, 9.7, 8).select("vec_id", "noise")


_EPS, _MIN = [9.9, 9.7, 9.5], [15, 10, 5]


@query("density_noise_grid", f"WITH {_PT}, " + ", ".join(
    _near_sql(["vec_id"], fx.POINT, e, f"p{i}") for i, e in enumerate(_EPS)) + ", g AS (" + " UNION ALL ".join(
    f"SELECT CAST({e} AS DOUBLE) AS eps, {m} AS min_samples, CASE WHEN label = 0 THEN 1 ELSE 0 END AS real, "
    f"CASE WHEN reach < {m} THEN 1 ELSE 0 END AS pred FROM p{i}_r JOIN embeddings USING (vec_id)"
    for i, e in enumerate(_EPS) for m in _MIN) + f"), c AS (SELECT eps, min_samples, {COUNTS} FROM g GROUP BY 1, 2) "
    f"SELECT eps, min_samples, {METRICS} FROM c", "pt")
def _(spark, sf_dir):
    truth = fx.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") == 0).cast("int").alias("real"))
    return density.density_noise_grid(_points(spark, sf_dir).join(truth, "vec_id"), fx.POINT, "real", _EPS, _MIN)


_Z10 = "z AS MATERIALIZED (SELECT station_id, day, anomaly, " + ", ".join(
    f"{_MEAN(c, 'e_features')} AS {c}" for c in fx.FEATURES) + " FROM e_features)"


@query("density_noise_features", f"WITH {_Z10}, {_near_sql(['station_id', 'day'], fx.FEATURES, 1.5, 'p')} "
       "SELECT station_id, day, CASE WHEN reach < 10 THEN 1 ELSE 0 END AS noise FROM p_r", "e_features")
def _(spark, sf_dir):
    z = scale.standardise(fx.e_features(spark, sf_dir).select(*KEYS, *fx.FEATURES), fx.FEATURES)
    z = stage_table(z, "standardised")
    return density.density_noise(z, fx.FEATURES, 1.5, 10).select(*KEYS, "noise")


_TRAIN_EPS, _TRAIN_MIN = [0.5, 0.45, 0.4], [50, 25, 15]
# The trained density detector: all candidates, the best of them, and its verdict on every row, unknown values included.
_TRAINED = ("zk AS MATERIALIZED (SELECT * EXCLUDE (" + ", ".join(fx.FEATURES) + "), " + ", ".join(
    f"{_MEAN(c, 'e_known')} AS {c}" for c in fx.FEATURES) + " FROM e_known), z AS (SELECT * FROM zk), "
    + ", ".join(_near_sql(["station_id", "day"], fx.FEATURES, e, f"t{i}") for i, e in enumerate(_TRAIN_EPS))
    + ", g AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT zk.*, {e} AS eps, {m} AS min_samples, CASE WHEN anomaly > 1 THEN 1 ELSE 0 END AS real, "
        f"CASE WHEN coalesce(reach, 0) < {m} THEN 1 ELSE 0 END AS pred FROM zk LEFT JOIN t{i}_r USING (station_id, day)"
        for i, e in enumerate(_TRAIN_EPS) for m in _TRAIN_MIN)
    + f"), gc AS (SELECT eps, min_samples, {COUNTS} FROM g GROUP BY 1, 2), best AS (SELECT eps, min_samples FROM "
      "(SELECT *, TP / nullif(TP + FN, 0) AS rec, (TP + TN) / (TP + TN + FP + FN) AS acc FROM gc) WHERE rec > 0 AND acc > 0.7 "
      "ORDER BY rec DESC, acc DESC LIMIT 1), verdict AS MATERIALIZED (SELECT zk.*, coalesce(f.pred, 0) AS hit FROM zk LEFT JOIN "
      "(SELECT station_id, day, pred FROM g JOIN best USING (eps, min_samples)) f USING (station_id, day))")


def _trained_density(spark, sf_dir):
    rows = stage_table(fx.e_features_known(spark, sf_dir), "features")
    return stage_table(flows.train("dbscan", rows, fx.E_PARAMS), "trained")


@query("train_and_check_density", f"WITH {_TRAINED}, c AS (" + " UNION ALL ".join(
    f"SELECT '{p}' AS param, {COUNTS} FROM (SELECT {p}_anomaly AS real, hit AS pred FROM verdict)" for p in fx.E_PARAMS)
    + f") SELECT param, {METRICS} FROM c", "e_known")
def _(spark, sf_dir):
    return flows.check(_trained_density(spark, sf_dir))


@query("check_global", f"WITH {_TRAINED}, c AS (SELECT {COUNTS} FROM (SELECT CASE WHEN anomaly > 0 THEN 1 ELSE 0 END AS real, "
       f"hit AS pred FROM verdict)) SELECT {METRICS} FROM c", "e_known")
def _(spark, sf_dir):
    return flows.check_global(_trained_density(spark, sf_dir))


@query("density_noise_unknown", f"WITH {_TRAINED} SELECT station_id, day, CASE WHEN coalesce(reach, 0) < 15 THEN 1 ELSE 0 END AS noise "
       "FROM zk LEFT JOIN t0_r USING (station_id, day)", "e_known")
def _(spark, sf_dir):
    z = scale.standardise(fx.e_features_known(spark, sf_dir).select(*KEYS, *fx.FEATURES), fx.FEATURES)
    return density.density_noise(stage_table(z, "standardised"), fx.FEATURES, 0.5, 15).select(*KEYS, "noise")


@query("density_grid_features", f"WITH {_Z10}, " + ", ".join(
    _near_sql(["station_id", "day"], fx.FEATURES, e, f"p{i}") for i, e in enumerate([1.5, 1.0])) + ", g AS (" + " UNION ALL ".join(
    f"SELECT CAST({e} AS DOUBLE) AS eps, {m} AS min_samples, CASE WHEN anomaly > 1 THEN 1 ELSE 0 END AS real, "
    f"CASE WHEN reach < {m} THEN 1 ELSE 0 END AS pred FROM p{i}_r JOIN z USING (station_id, day)"
    for i, e in enumerate([1.5, 1.0]) for m in (15, 5)) + f"), c AS (SELECT eps, min_samples, {COUNTS} FROM g GROUP BY 1, 2) "
    f"SELECT eps, min_samples, {METRICS} FROM c", "e_features")
def _(spark, sf_dir):
    z = scale.standardise(fx.e_features(spark, sf_dir).select(*KEYS, (F.col("anomaly") > 1).cast("int").alias("real"), *fx.FEATURES),
                          fx.FEATURES)
    return density.density_noise_grid(stage_table(z, "standardised"), fx.FEATURES, "real", [1.5, 1.0], [15, 5])


@query("train_and_check_forest")
def _(spark, sf_dir):
    rows = stage_table(fx.e_features(spark, sf_dir), "features")
    prepared = flows.prepare("isolationForest", rows, fx.stations(spark, sf_dir), spatial=True)
    return flows.check(flows.train("isolationForest", prepared, fx.E_PARAMS, spatial=True))


# Trees over all rows, followed level by level: SQL draws features and cuts from the same hashes.
_TREE_COLS, _TREES, _LEVELS, _SEED = [raw("click"), "Altitude", "Lambert93x"], 3, 20, 42
_U = lambda node, salt: (f"(CAST('0x' || substr(md5('{_SEED}:' || tree || ':' || {node} || ':{salt}'), 1, 13) AS BIGINT)"  # noqa: E731
                         " / CAST(4503599627370496 AS DOUBLE))")
_PATH = lambda c: f"CASE WHEN {c} > 2 THEN 2 * (ln({c} - 1) + 0.5772156649015329) - 2.0 * ({c} - 1) / {c} WHEN {c} = 2 THEN 1 ELSE 0 END"


def _tree_sql() -> str:
    n, width = "(SELECT count(*) FROM e_features)", len(_TREE_COLS)
    steps = [f"f AS (SELECT tree, list(i ORDER BY {_U('i', 'feature')}) AS features FROM (SELECT unnest(range({_TREES})) AS tree), "
             f"(SELECT unnest(range({width})) AS i) GROUP BY tree)",
             f"r0 AS MATERIALIZED (SELECT station_id, day, [{', '.join(_TREE_COLS)}] AS x, tree, CAST(1 AS BIGINT) AS node FROM e_features, f)"]
    for k in range(_LEVELS):
        low, high = ("[" + ", ".join(f"{fn}(x[{i + 1}])" for i in range(width)) + "]" for fn in ("min", "max"))
        steps += [
            f"g{k} AS (SELECT tree, node, count(*) AS c, {low} AS lo, {high} AS hi FROM r{k} GROUP BY tree, node)",
            f"a{k} AS (SELECT g.*, CASE WHEN {k} >= greatest(1, ceil(log2(greatest({n}, 2)))) THEN [] "
            f"ELSE list_filter(features, lambda i: lo[i + 1] < hi[i + 1]) END AS able FROM g{k} g JOIN f USING (tree))",
            f"s{k} AS MATERIALIZED (SELECT tree, node, c, CASE WHEN len(able) > 0 THEN able[1 + CAST(floor({_U('node', 1)} * len(able)) AS INTEGER)] END AS i, "
            f"lo, hi, {_U('node', 2)} AS u FROM a{k})",
            f"e{k} AS MATERIALIZED (SELECT station_id, day, {k} + {_PATH('c')} AS length FROM r{k} JOIN s{k} USING (tree, node) WHERE i IS NULL)",
            f"r{k + 1} AS MATERIALIZED (SELECT station_id, day, x, tree, 2 * node + CASE WHEN x[i + 1] > lo[i + 1] + u * (hi[i + 1] - lo[i + 1]) THEN 1 ELSE 0 END AS node "
            f"FROM r{k} JOIN s{k} USING (tree, node) WHERE i IS NOT NULL)"]
    ends = " UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(_LEVELS))
    return (f"WITH {', '.join(steps)}, ends AS ({ends}) SELECT station_id, day, round(pow(2, -sum(length) / {_TREES} / ({_PATH(n)})), 6) AS score "
            "FROM ends GROUP BY station_id, day")


@query("isolation_trees", _tree_sql(), "e_features")
def _(spark, sf_dir):
    rows = stage_table(fx.e_features(spark, sf_dir).select(*KEYS, *_TREE_COLS), "features")
    forest = isoforest.Forest(tuple(_TREE_COLS), _TREES, 10 ** 9)
    nodes = isoforest.grow_forests(rows, [forest], KEYS, _SEED)
    return isoforest.add_scores(rows, nodes, [("score", forest, 0, _TREES)], rows.count()).select(*KEYS, "score")


@query("isolation_forest")
def _(spark, sf_dir):
    rows = stage_table(fx.e_features(spark, sf_dir), "features")
    scored = isoforest.isolation_forest(rows, fx.FEATURES)
    return scored.select(*KEYS, "anomaly", "anomaly_score", "anomaly_pred")


@query("isolation_forest_by_param")
def _(spark, sf_dir):
    rows = stage_table(fx.e_features(spark, sf_dir), "features")
    scored = isoforest.isolation_forest_by_param(rows, fx.E_PARAMS)
    return scored.select(*KEYS, *[f"{p}_anomaly_pred" for p in fx.E_PARAMS])


@query("isolation_forest_grid")
def _(spark, sf_dir):
    rows = stage_table(fx.e_features(spark, sf_dir), "features")
    grid = {"trees": [25, 50, 75, 100, 200], "contamination": isoforest.contaminations(rows, "anomaly") or [0.14],
            "max_samples": [0.5, 0.2, 0.05], "max_features": [8, 6, 4, 1]}
    return isoforest.isolation_forest_grid(rows, fx.FEATURES, "anomaly", grid)


@query("cluster_stations")
def _(spark, sf_dir):
    return cluster.cluster_stations(fx.stations(spark, sf_dir)).select("station_id", "cluster")


@query("choose_k")
def _(spark, sf_dir):
    return cluster.choose_k(stage_table(fx.stations(spark, sf_dir), "stations"))


@query("pca_variance")
def _(spark, sf_dir):
    shares = cluster.pca_variance(stage_table(fx.e_features(spark, sf_dir), "features"), fx.FEATURES)
    return profile.cumulative_share(shares, "share", "component")


@query("pca_variance_pair", f"""WITH c AS (SELECT abs(corr(A, A_origine)) AS r FROM l_dense)
    SELECT CAST(1 AS INTEGER) AS component, {r6('(1 + r) / 2 AS share')} FROM c
    UNION ALL SELECT CAST(2 AS INTEGER), {r6('(1 - r) / 2 AS share')} FROM c""", "l_dense")
def _(spark, sf_dir):
    return cluster.pca_variance(fx.l_dense(spark, sf_dir), ["A", raw("A")])


@query("pca_project")
def _(spark, sf_dir):
    rows = stage_table(fx.e_features(spark, sf_dir).select(*KEYS, "anomaly", *fx.FEATURES), "features")
    return cluster.pca_project(rows, fx.FEATURES).select(*KEYS, "anomaly", "pc1", "pc2")


_META = ["Altitude", "Lambert93x", "Lambert93y", "day_sin", "day_cos"]


def _reconstruction_sql() -> str:
    """Each parameter from the others: normal equations as sums over the training rows, solved by elimination."""
    params, cols = fx.E_FORECAST, [*fx.E_FORECAST, *_META]
    m, n = len(cols) + 1, len(params)
    unit = lambda c: f"((SELECT CASE WHEN hi_{c} = lo_{c} THEN 1 ELSE hi_{c} - lo_{c} END FROM mm))"
    scaled = ", ".join(f"(CAST({c} AS DOUBLE) - (SELECT lo_{c} FROM mm)) / {unit(c)}" for c in cols)
    observed = ", ".join(f"{raw(p)} AS {p}" for p in params)
    known = ", ".join(f"coalesce({p}, 0) AS {p}" for p in params)
    equations = f"""SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) AS i, list(g ORDER BY j = k, j) AS r
        FROM (SELECT i, j, sum(v[i] * v[j]) AS g FROM ztrain, range(1, {m + 1}) a(i), range(1, {m + 1}) b(j) GROUP BY i, j), range(1, {n + 1}) s(k)
        WHERE i <> k GROUP BY k, i"""
    # the weights of a system in the places of its columns, 0 for the column it predicts
    pred = f"list_sum(list_transform(range(1, {m + 1}), lambda j: CASE WHEN j = k THEN 0 ELSE v[j] * w[CASE WHEN j < k THEN j ELSE j - 1 END] END))"
    limit = f"SELECT k, quantile_cont(abs({pred} - v[k]), 0.9) AS cut FROM ztrain, weights GROUP BY k"
    each = f"SELECT station_id, day, anomaly, k, {pred} AS pred, v[k] AS own FROM ztest, weights"
    back = ", ".join(f"round(max(CASE WHEN k = {i + 1} THEN pred END) * {unit(p)} + (SELECT lo_{p} FROM mm), 6) AS {p}_pred" for i, p in enumerate(params))
    flags = ", ".join(f"max(CASE WHEN k = {i + 1} AND abs(pred - own) > cut THEN 1 ELSE 0 END) AS {p}_anomaly_pred" for i, p in enumerate(params))
    return f"""WITH f AS (SELECT * REPLACE ({known}) FROM e_features),
        train AS (SELECT * FROM f WHERE day <= DATE '2024-01-20'),
        test AS (SELECT * EXCLUDE ({', '.join(params)}), {observed} FROM f WHERE day > DATE '2024-01-20'),
        mm AS MATERIALIZED (SELECT {', '.join(f'CAST(min({c}) AS DOUBLE) AS lo_{c}, CAST(max({c}) AS DOUBLE) AS hi_{c}' for c in cols)} FROM train),
        ztrain AS MATERIALIZED (SELECT [{scaled}, 1] AS v FROM train), ztest AS MATERIALIZED (SELECT station_id, day, anomaly, [{scaled}, 1] AS v FROM test),
        {solve_sql('weights', equations, m - 1)}, limits AS ({limit}), each AS ({each})
        SELECT station_id, day, any_value(anomaly) AS anomaly, {back}, {flags}, max(CASE WHEN abs(pred - own) > cut THEN 1 ELSE 0 END) AS anomaly_pred
        FROM each JOIN limits USING (k) GROUP BY station_id, day"""


@query("reconstruction_residual", _reconstruction_sql(), "e_features")
def _(spark, sf_dir):
    rows = stage_table(fx.e_features(spark, sf_dir).fillna(0.0, fx.E_FORECAST), "features")
    early = F.col("day") <= "2024-01-20"
    params = fx.E_FORECAST
    observed = rows.withColumns({p: F.col(raw(p)) for p in params})
    scored = residual.reconstruction_residual(rows.filter(early), observed.filter(~early), params,
                                              _META)
    return scored.select(*KEYS, "anomaly", *[f"{p}_pred" for p in params], *[f"{p}_anomaly_pred" for p in params],
                         "anomaly_pred")


@query("linear_forecast", f"""WITH w AS (SELECT station_id, day, A, lag(A) OVER (PARTITION BY station_id ORDER BY day) AS x
    FROM l_dense), m AS (SELECT regr_slope(A, x) AS s, regr_intercept(A, x) AS i FROM w)
    SELECT station_id, day AS last_day, {r6('A AS label', 's * x + i AS pred')} FROM w, m WHERE x IS NOT NULL""", "l_dense")
def _(spark, sf_dir):
    windows = series.input_label_windows(fx.l_dense(spark, sf_dir), ["A"], 1, 1, 1, ["A"])
    return residual.linear_forecast(windows, ["A"], "A")[1].drop("features")


_DENSE = ["A", "R", "A_origine", "R_origine"]


@query("linear_forecast_wide")
def _(spark, sf_dir):
    windows = series.input_label_windows(fx.l_dense(spark, sf_dir), _DENSE, 4, 1, 1, ["A"])
    return residual.linear_forecast(windows, _DENSE, "A")[1].drop("features")


# Quarterly series: the first three tenths of the quarters train, the later half is forecast from values as they were measured.
_WIDTH, _NEAR = 2, 3
_OWN = fx.L_PARAMS
_SPATIAL = [*_OWN, *(f"{p}_{i}" for i in range(_NEAR) for p in _OWN)]


def _spatial(spark, sf_dir):
    dense = stage_table(fx.l_dense(spark, sf_dir), "dense")
    quarters = F.sort_array(F.collect_set("day"))
    part = lambda share: F.floor(F.size("q") * share).cast("int")
    first, later = dense.agg(quarters.alias("q")).select(F.col("q")[part(0.3)], F.col("q")[part(0.5)]).first()
    active = stage_table(neighbours.active_neighbours_daily(dense.select(*KEYS), fx.stations(spark, sf_dir)), "active")
    known = dense.select(*KEYS, *_OWN)
    measured = dense.select(*KEYS, *[F.col(raw(p)).alias(p) for p in _OWN])
    around = lambda df: stage_table(neighbours.attach_active_neighbours(df, active, _OWN, _NEAR), "with-neighbours")
    train, test = around(known).filter(F.col("day") < first), around(measured).filter(F.col("day") >= later)
    return residual.spatial_forecast_residual(train, test, _SPATIAL, _OWN[0], _WIDTH)


def _spatial_sql(flag: str) -> str:
    near = f"""near_l AS MATERIALIZED (SELECT d.station_id, d.day, p.other_id, row_number() OVER (PARTITION BY d.station_id, d.day ORDER BY p.km, p.other_id) AS rn
        FROM l_dense d JOIN pairs p USING (station_id) JOIN (SELECT station_id, min(day) AS first_day, max(day) AS last_day FROM l_dense GROUP BY station_id) v
        ON v.station_id = p.other_id AND v.first_day <= d.day AND v.last_day > d.day QUALIFY rn <= {_NEAR})"""

    def around(name, suffix):
        near = ", ".join(f"max(CASE WHEN rn = {i + 1} THEN n.{p}{suffix} END) AS {p}_{i}" for i in range(_NEAR) for p in _OWN)
        own = ", ".join(f"any_value(d.{p}{suffix}) AS {p}" for p in _OWN)
        return (f"{name} AS MATERIALIZED (SELECT d.station_id, d.day, {own}, {near} FROM l_dense d LEFT JOIN near_l a USING (station_id, day) "
                f"LEFT JOIN l_dense n ON n.station_id = a.other_id AND n.day = d.day GROUP BY d.station_id, d.day)")

    width, m = len(_SPATIAL), _WIDTH * len(_SPATIAL) + 1
    unit = lambda c: f"(SELECT CASE WHEN stddev_samp({c}) = 0 THEN 1 ELSE stddev_samp({c}) END FROM train)"
    scaled = ", ".join(f"coalesce(({c} - (SELECT avg({c}) FROM train)) / {unit(c)}, 0)" for c in _SPATIAL)
    lags = ", ".join(f"lag(z, {_WIDTH - i}) OVER s AS z{i}" for i in range(_WIDTH))
    flat = "list_concat(" * _WIDTH + "z0" + "".join(f", z{i})" for i in range(1, _WIDTH)) + ", [1])"
    windows = (f"SELECT station_id, day, part, {flat} AS v, z[1] AS label FROM (SELECT *, {lags} FROM z WINDOW s AS (PARTITION BY part, station_id ORDER BY day)) "
               "WHERE z0 IS NOT NULL")
    equations = f"""SELECT 1 AS k, i, list(g ORDER BY j) AS r FROM (SELECT i, j, sum(v[i] * CASE WHEN j = {m + 1} THEN label ELSE v[j] END) AS g
        FROM w, range(1, {m + 1}) a(i), range(1, {m + 2}) b(j) WHERE part = 1 GROUP BY i, j) GROUP BY i"""
    assert width * _WIDTH + 1 == m
    return f"""WITH {near}, {around('known', '')}, {around('measured', '_origine')}, quarters AS (SELECT list(DISTINCT day ORDER BY day) AS q FROM l_dense),
        train AS MATERIALIZED (SELECT known.* FROM known, quarters WHERE day < q[CAST(floor(len(q) * 0.3) AS INTEGER) + 1] AND {_OWN[0]} IS NOT NULL),
        test AS (SELECT measured.* FROM measured, quarters WHERE day >= q[CAST(floor(len(q) * 0.5) AS INTEGER) + 1] AND {_OWN[0]} IS NOT NULL),
        z AS MATERIALIZED (SELECT station_id, day, 1 AS part, [{scaled}] AS z FROM train UNION ALL SELECT station_id, day, 2, [{scaled}] FROM test),
        w AS MATERIALIZED ({windows}), {solve_sql('weights', equations, m)},
        scored AS MATERIALIZED (SELECT station_id, day, part, label, list_sum(list_transform(range(1, {m + 1}), lambda j: v[j] * w[j])) AS pred FROM w, weights),
        residuals AS (SELECT *, abs(label - pred) AS residual FROM scored WHERE part = 2)
        SELECT station_id, day, {r6('label', 'pred', 'residual')}, CASE WHEN residual > ({flag}) THEN 1 ELSE 0 END AS anomaly_pred FROM residuals"""


@query("spatial_forecast_residual", _spatial_sql("SELECT quantile_cont(abs(label - pred), 0.5) FROM scored WHERE part = 1"), "l_dense", "pairs")
def _(spark, sf_dir):
    return _spatial(spark, sf_dir)


@query("rmse_threshold_flags", _spatial_sql("SELECT sqrt(avg(residual * residual)) FROM residuals"), "l_dense", "pairs")
def _(spark, sf_dir):
    return residual.rmse_threshold_flags(stage_table(_spatial(spark, sf_dir), "spatial"))
