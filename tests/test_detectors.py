from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugewarden.detectors import DETECTORS, check_columns, cluster, density, isoforest, residual
from gaugewarden.operators import series
from gaugewarden.schema import raw

D = date(2020, 1, 1)


def points(kind, dims, n=300):
    rng = np.random.default_rng(8)
    p = rng.normal(size=(n, dims))
    if kind == "copies":
        p[: n // 3] = p[0]
    if kind == "crowd":
        p[: n // 3] = rng.normal(0, 0.01, (n // 3, dims)) + p[0]
    if kind == "zeros":
        p[rng.random((n, dims)) < 0.5] = 0.0
    return pd.DataFrame(p, columns=[f"c{i}" for i in range(dims)])


def brute_reach(p, eps):
    d2 = ((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)
    near = d2 <= eps * eps
    counts = near.sum(axis=1)
    return counts, np.where(near, counts[None, :], 0).max(axis=1)


@pytest.mark.parametrize("kind", ["spread", "copies", "crowd", "zeros"])
@pytest.mark.parametrize("dims,eps", [(2, 0.3), (5, 1.0), (10, 2.5)])
def test_noise_is_exact(spark, kind, dims, eps):
    pdf = points(kind, dims)
    cols = list(pdf.columns)
    _, reach = brute_reach(pdf.to_numpy(), eps)
    df = spark.createDataFrame(pdf.assign(id=range(len(pdf))))
    got = density.density_noise(df, cols, eps, 6).toPandas().sort_values("id")
    assert got["id"].tolist() == list(range(len(pdf)))
    assert (got["noise"].to_numpy() == (reach < 6)).all()


def reach_of(spark, pdf, eps, enough, **options):
    cols = list(pdf.columns)
    found = density.density_reach(spark.createDataFrame(pdf), cols, eps, enough, **options)
    return pdf.merge(found.toPandas(), on=cols, how="left")["reach"]


@pytest.mark.parametrize("kind,dims,sent_cells", [("spread", 2, 2_000), ("crowd", 4, 0), ("copies", 2, 0), ("zeros", 6, 2_000)])
def test_reach_over_a_tree_of_cells(spark, kind, dims, sent_cells):
    """Many small leaves, distances from nothing to the diameter, and no bound on what counts."""
    pdf = points(kind, dims, 500)
    p = pdf.to_numpy()
    diameter = np.sqrt(((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)).max()
    eps = [0.0, 0.2, diameter / 4, diameter * 1.001]
    got = np.stack(reach_of(spark, pdf, eps, 10 ** 9, leaf_points=15, sent_cells=sent_cells))
    for i, e in enumerate(eps):
        assert (got[:, i] == brute_reach(p, e)[1]).all()
    few = np.stack(reach_of(spark, pdf, eps[1:], 7, leaf_points=15, sent_cells=sent_cells))
    assert (few == np.minimum(got[:, 1:], 7)).all()


def test_a_reach_over_all_points_costs_boxes_and_no_points(spark):
    """No leaf asks for the points of another; the plan does not grow with the number of leaves."""
    sizes = []
    for n in (300, 3_000):
        rng = np.random.default_rng(n)
        df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(n, 3)), columns=["c0", "c1", "c2"]))
        rows = df.select(F.array("c0", "c1", "c2").alias("x"), F.lit(1).cast("long").alias("w"), F.monotonically_increasing_id().alias("id"))
        cells, depth = density._with_cells(rows, density._axes(rows, 3), 10, 2_000)
        levels = density._boxes(cells, 3, depth, [F.sum("w")], False)
        leaves = levels[-1].count()
        assert leaves > n / 20 and cells.groupBy("cell").count().agg(F.max("count")).first()[0] < 60
        base, doubt = density._walk(levels, [50.0], 10 ** 9, False, 2_000)
        assert doubt.count() == 0 and {tuple(r["base"]) for r in base.collect()} == {(n,)}
        _, doubt = density._walk(levels, [0.1], 5, False, 2_000)
        assert doubt.count() < leaves ** 2 / 2
        found = density.density_reach(df, ["c0", "c1", "c2"], 1.0, 5, leaf_points=10)
        sizes.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(sizes[0] - sizes[1]) < sizes[0] / 10


def test_a_point_counts_itself_and_a_border_point_is_not_noise(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (9.0,)], "x double")
    got = {r["x"]: r["noise"] for r in density.density_noise(df, ["x"], 1.0, 3).collect()}
    assert got == {0.0: 0, 1.0: 0, 2.0: 0, 3.0: 0, 9.0: 1}


def test_one_search_serves_every_min_samples(spark):
    pdf = points("crowd", 2)
    pdf["real"] = np.arange(len(pdf)) % 3 == 0
    df = spark.createDataFrame(pdf).withColumn("real", F.col("real").cast("int"))
    got = density.density_noise_grid(df, ["c0", "c1"], "real", [0.2, 0.4], [12, 6, 3]).collect()
    for r in got:
        _, reach = brute_reach(pdf[["c0", "c1"]].to_numpy(), r["eps"])
        noise = reach < r["min_samples"]
        assert (r["TP"], r["FP"]) == ((noise & pdf["real"]).sum(), (noise & ~pdf["real"]).sum())
    assert len(got) == 6


def measured(n=600, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"station_id": np.arange(n) % 20, "day": [D + timedelta(days=int(i // 20)) for i in range(n)],
                        "ETP_origine": rng.normal(size=n), "GLOT_origine": rng.normal(size=n),
                        "day_sin": rng.uniform(-1, 1, n), "day_cos": rng.uniform(-1, 1, n)})
    pdf.loc[:11, "ETP_origine"] = 25.0
    return pdf.assign(ETP_anomaly=(pdf.index < 12).astype(int), GLOT_anomaly=(pdf.index % 50 == 0).astype(int),
                      anomaly=(pdf.index < 12).astype(int))


def test_forest_finds_planted_outliers_and_keeps_the_share(spark):
    df = spark.createDataFrame(measured())
    cols = ["ETP_origine", "GLOT_origine", "day_sin", "day_cos"]
    out = isoforest.isolation_forest(df, cols, trees=60, max_samples=128, max_features=4, contamination=0.1).toPandas()
    planted = out["ETP_origine"] == 25.0
    assert out.loc[planted, "anomaly_score"].min() > out["anomaly_score"].median()
    assert abs(out["anomaly_pred"].mean() - 0.1) <= 2 / len(out)
    assert out.loc[planted, "anomaly_pred"].mean() > 0.9


def test_same_seed_same_forest_whatever_the_partitions(spark):
    df = spark.createDataFrame(measured())
    run = lambda d: isoforest.isolation_forest(d, ["ETP_origine", "day_sin"], 20, 64, None, 0.1, seed=5).select(
        "station_id", "day", "anomaly_score").toPandas().sort_values(["station_id", "day"])["anomaly_score"].to_numpy()
    np.testing.assert_allclose(run(df), run(df.repartition(7)))


def test_tree_samples_have_the_wanted_size(spark):
    df = spark.createDataFrame(measured())
    forest = isoforest.Forest(("ETP_origine", "GLOT_origine"), 10, 0.2)
    sample = isoforest._samples(df, [forest], [120], 600, ["station_id", "day"], 42, {})
    sizes = [r["count"] for r in sample.groupBy("tree").count().collect()]
    assert len(sizes) == 10 and abs(np.mean(sizes) - 120) < 12 and min(sizes) > 80
    assert isoforest.grow_forests(df, [forest], ["station_id", "day"]).select("tree").distinct().count() == 10
    assert isoforest.Forest(("a",), 10, 0.2).sample_size(1_000_000) == 200_000
    assert isoforest.Forest(("a",), 10, 0.2).sample_size(600) == 120
    assert isoforest.Forest(("a",), 10, 256).sample_size(100) == 100


def test_large_nodes_are_split_by_aggregates(spark):
    """The same trees in kind: sizes halve, leaves are as deep, planted outliers score high; joins score like one pass."""
    df = spark.createDataFrame(measured())
    forest = isoforest.Forest(("ETP_origine", "GLOT_origine", "day_sin"), 30, 0.5)
    key = ["station_id", "day"]
    nodes = isoforest.grow_forests(df, [forest], key, task_rows=20)
    local = isoforest.grow_forests(df, [forest], key)
    inner, leaves = nodes.filter("feature >= 0").count(), nodes.filter("feature < 0").count()
    assert leaves == inner + 30 and nodes.select("tree", "node").distinct().count() == nodes.count()
    assert nodes.agg(F.max(F.length(F.bin("node")))).first()[0] <= 1 + np.ceil(np.log2(300))
    case = [("s", forest, 0, 30)]
    one = isoforest.add_scores(df, nodes, case, 600).select(*key, "s").toPandas().sort_values(key)["s"].to_numpy()
    joined = isoforest.add_scores(df, nodes, case, 600, sent_nodes=0).select(*key, "s").toPandas().sort_values(key)["s"].to_numpy()
    grown_in_tasks = isoforest.add_scores(df, local, case, 600).select(*key, "s").toPandas().sort_values(key)["s"].to_numpy()
    np.testing.assert_allclose(one, joined)
    assert np.corrcoef(one, grown_in_tasks)[0, 1] > 0.8


def test_trees_do_not_depend_on_how_they_are_grown(spark):
    """Node for node, whether by aggregates, in tasks or by both; copies make a third of the rows, so leaves end at the depth."""
    pdf = measured()
    pdf.loc[:199, ["ETP_origine", "GLOT_origine", "day_sin"]] = 0.5
    df = spark.createDataFrame(pdf)
    forests = [isoforest.Forest(("ETP_origine", "GLOT_origine", "day_sin"), 4, 0.5, 2), isoforest.Forest(("GLOT_origine", "day_cos"), 3, 10 ** 9)]
    found = [sorted(map(tuple, isoforest.grow_forests(df, forests, ["station_id", "day"], task_rows=t).collect())) for t in (2, 20, 100_000)]
    assert found[0] == found[1] == found[2] and len({t for _, t, *_ in found[0]}) == 7


@pytest.mark.parametrize("sent_nodes", [0, 40, 400])
def test_scores_past_tops_and_subtrees_are_those_of_one_pass(spark, sent_nodes):
    df = spark.createDataFrame(measured())
    key = ["station_id", "day"]
    forests = [isoforest.Forest(("ETP_origine", "GLOT_origine", "day_sin"), 6, 0.5), isoforest.Forest(("day_cos", "ETP_origine"), 5, 64, 1)]
    nodes = isoforest.grow_forests(df, forests, key)
    cases = [("a", forests[0], 0, 6), ("b", forests[0], 0, 2), ("c", forests[1], 1, 5)]
    whole = isoforest.add_scores(df, nodes, cases, 600).toPandas().sort_values(key)
    routed = isoforest.add_scores(df, nodes, cases, 600, sent_nodes=sent_nodes).toPandas().sort_values(key)
    assert list(whole.columns) == list(routed.columns) and len(whole) == len(routed)
    np.testing.assert_allclose(whole[["a", "b", "c"]].to_numpy(), routed[["a", "b", "c"]].to_numpy(), rtol=1e-12)


def test_unknown_features_are_refused_unless_stated(spark):
    df = spark.createDataFrame(measured()).withColumn("GLOT_origine", F.when(F.col("GLOT_origine") > 0, F.col("GLOT_origine")))
    with pytest.raises(Exception, match="unknown value in GLOT_origine"):
        isoforest.isolation_forest(df, ["ETP_origine", "GLOT_origine"], 5)
    out = isoforest.isolation_forest(df, ["ETP_origine", "GLOT_origine"], 5, fill={"GLOT_origine": 0.0})
    assert out.count() == 600


def test_density_keeps_rows_with_unknown_values(spark):
    pdf = measured()
    pdf.loc[5, "GLOT_origine"] = None
    found = density.detect(spark.createDataFrame(pdf).withColumn("anomaly", F.lit(2)), ["ETP"], ["ETP_origine", "GLOT_origine"],
                           [0.5, 0.2], [5, 3]).toPandas()
    assert len(found) == 600 and set(found["anomaly_pred"]) <= {0, 1}
    noise = density.density_noise(spark.createDataFrame(pdf), ["ETP_origine", "GLOT_origine"], 0.5, 3).toPandas()
    assert len(noise) == 600 and noise.loc[noise["GLOT_origine"].isna(), "noise"].tolist() == [1]


@pytest.mark.parametrize("kind", ["spread", "crowd"])
def test_leaves_do_not_change_the_noise(spark, kind):
    pdf = points(kind, 5)
    cols = list(pdf.columns)
    df = spark.createDataFrame(pdf)
    counts = []
    for leaf in (20, 100, 10_000):
        got = density.density_reach(df, cols, [1.0, 0.6], 6, leaf_points=leaf).toPandas().sort_values(cols)
        counts.append(np.stack(got["reach"].to_numpy()))
    for e, eps in enumerate((1.0, 0.6)):
        _, reach = brute_reach(pdf.drop_duplicates().sort_values(cols).to_numpy(), eps)
        assert (np.minimum(reach, 6) == counts[0][:, e]).all()
    assert (counts[0] == counts[1]).all() and (counts[0] == counts[2]).all()


def test_one_forest_per_parameter_with_its_own_share(spark):
    out = isoforest.isolation_forest_by_param(spark.createDataFrame(measured()), ["ETP", "GLOT"], trees=40).toPandas()
    assert abs(out["ETP_anomaly_pred"].sum() - 12) <= 2 and abs(out["GLOT_anomaly_pred"].sum() - 12) <= 2


def test_forest_grid_has_a_row_per_combination(spark):
    grid = {"trees": [5, 10], "contamination": [0.05, 0.2], "max_samples": [64], "max_features": [2, 1]}
    out = isoforest.isolation_forest_grid(spark.createDataFrame(measured()), ["ETP_origine", "GLOT_origine"], "anomaly", grid)
    got = out.collect()
    assert len(got) == 8 and all(r["TP"] + r["TN"] + r["FP"] + r["FN"] == 600 for r in got)


def test_reconstruction_flags_what_the_others_do_not_explain(spark):
    rng = np.random.default_rng(2)
    n = 400
    a = rng.normal(size=n)
    pdf = pd.DataFrame({"a": a, "b": 2 * a + 1 + rng.normal(0, 0.01, n), "m": rng.normal(size=n)})
    test = pdf.head(50).copy()
    test.loc[7, "b"] += 3
    out = residual.reconstruction_residual(
        spark.createDataFrame(pdf), spark.createDataFrame(test.assign(id=range(50))), ["a", "b"], ["m"], q=1.0).toPandas()
    assert out.loc[out["id"] == 7, "anomaly_pred"].item() == 1 and out["anomaly_pred"].sum() == 1
    np.testing.assert_allclose(out["b_pred"], 2 * out["a"] + 1, atol=0.1)


def test_forecast_learns_a_linear_rule(spark):
    v = [1.0, 2.0]
    for _ in range(80):
        v.append(float(0.5 * v[-1] - 0.3 * v[-2] + 1 + 0.01 * np.sin(len(v) ** 2)))
    df = spark.createDataFrame([(1, D + timedelta(days=i), x) for i, x in enumerate(v)], "station_id int, day date, TN double")
    model, scored = residual.linear_forecast(series.input_label_windows(df, ["TN"], 2, 1, 1, ["TN"]), ["TN"], "TN")
    np.testing.assert_allclose(model.coefficients.toArray(), [-0.3, 0.5], atol=0.02)
    assert scored.count() == len(v) - 2


def test_spatial_forecast_flags_above_the_training_quantile(spark):
    rng = np.random.default_rng(0)
    rows = [(s, D + timedelta(days=d), float(np.sin(d / 5) + rng.normal(0, 0.1)), float(np.sin(d / 5)))
            for s in range(3) for d in range(100)]
    df = spark.createDataFrame(rows, "station_id int, day date, TN double, TN_0 double")
    early = F.col("day") < D + timedelta(days=60)
    out = residual.spatial_forecast_residual(df.filter(early), df.filter(~early), ["TN", "TN_0"], "TN", 5, 0.5).toPandas()
    assert len(out) == 3 * 35 and 0.2 < out["anomaly_pred"].mean() < 0.8
    flags = residual.rmse_threshold_flags(spark.createDataFrame(out)).toPandas()["anomaly_pred"]
    assert 0 < flags.mean() < 0.5


def test_clusters_and_components(spark):
    pdf = pd.DataFrame({"station_id": range(40), "Lambert93x": [0.0, 1e5, 0.0, 1e5] * 10, "Lambert93y": [0.0, 0.0, 1e5, 1e5] * 10,
                        "Altitude": [100.0, 100.5] * 20})
    st = spark.createDataFrame(pdf)
    out = cluster.cluster_stations(st).toPandas()
    assert out.groupby(["Lambert93x", "Lambert93y"])["cluster"].nunique().max() == 1
    ks = cluster.choose_k(st, [2, 3, 4]).toPandas()
    assert ks["inertia"].is_monotonic_decreasing
    shares = cluster.pca_variance(st, ["Lambert93x", "Lambert93y"]).toPandas()["share"]
    assert shares.sum() == pytest.approx(1.0)


def test_unprepared_tables_are_refused(spark):
    df = spark.createDataFrame([(1,)], "ETP_anomaly int")
    with pytest.raises(ValueError):
        check_columns(df, ["ETP", "TN"])
    with pytest.raises(ValueError):
        DETECTORS["isolationForest"].train(df, ["ETP"], True, 1)
    assert raw("ETP") == "ETP_origine"


def test_samples_are_sent_packed_and_scores_take_whole_trees_in_turn(spark):
    """Large nodes cost no copies of the samples; groups of trees give the scores of one pass without a row per row and tree."""
    df, key = spark.createDataFrame(measured()), ["station_id", "day"]
    forests = [isoforest.Forest(("ETP_origine", "GLOT_origine", "day_sin"), 6, 0.5), isoforest.Forest(("day_cos", "ETP_origine"), 5, 64, 1)]
    rows, places = isoforest._features(df, forests, key, 42, {})
    trees = {t: [0] for _, t in isoforest._owners(forests)}
    packed = isoforest._packed_samples(rows.coalesce(1), forests, places, [300, 64], 600, trees, {}).toPandas()
    assert len(packed) == 11 and (packed["rows"].map(len) == packed["n"] * 8).all()
    nodes = isoforest.grow_forests(df, forests, key, task_rows=50)
    cases = [("a", forests[0], 0, 6), ("b", forests[0], 0, 2), ("c", forests[1], 1, 5)]
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0]
    whole = isoforest.add_scores(df, nodes, cases, 600).toPandas().sort_values(key)
    groups = isoforest.add_scores(df, nodes, cases, 600, sent_nodes=most)
    assert not any("rows-past-tops" in f for f in groups.inputFiles()) and any("forest-passes" in f for f in groups.inputFiles())
    np.testing.assert_allclose(whole[["a", "b", "c"]].to_numpy(), groups.toPandas().sort_values(key)[["a", "b", "c"]].to_numpy(), rtol=1e-12)


def test_only_points_short_of_neighbours_see_other_leaves(spark):
    pdf = points("crowd", 3, 400)
    p, cols = pdf.to_numpy(), list(pdf.columns)
    eps = [1.2, 0.8]
    for enough in (6, 10 ** 6):
        got = np.stack(reach_of(spark, pdf, eps, enough, leaf_points=40))
        for i, e in enumerate(eps):
            assert (got[:, i] == np.minimum(brute_reach(p, e)[1], enough)).all()
    raw_rows = spark.createDataFrame(pdf).select(F.array(*cols).alias("x"), F.lit(1).cast("long").alias("w"), F.monotonically_increasing_id().alias("id"))
    cells, depth = density._with_cells(raw_rows, density._axes(raw_rows, 3), 40, 2_000)
    levels = density._boxes(cells, 3, depth, [F.sum("w")], False)
    base, doubt = density._walk(levels, [1.2], 6, False, 2_000)
    home = density._search(density._visits(cells, base, doubt, []), [1.2], 6, None, "counts").cache()
    short = home.filter(F.col("counts")[0] < 6).count()
    seen = density._guests(cells, home, doubt, 6, "w", "counts")
    assert 0 < short < 200 and seen.filter("visitor").select("id").distinct().count() <= short
    assert seen.filter("not visitor").count() == 400


def test_points_see_only_leaves_that_their_own_place_reaches(spark):
    """Nearest leaves first, then the others, none twice; and no leaf whose box is out of a point's reach."""
    pdf = points("spread", 4, 600)
    cols = list(pdf.columns)
    rows = spark.createDataFrame(pdf).select(F.array(*cols).alias("x"), F.lit(1).cast("long").alias("w"), F.monotonically_increasing_id().alias("id"))
    cells, depth = density._with_cells(rows, density._axes(rows, 4), 20, 2_000)
    levels = density._boxes(cells, 4, depth, [F.sum("w")], False)
    base, doubt = density._walk(levels, [0.8], 50, False, 2_000)
    home = density._search(density._visits(cells, base, doubt, []), [0.8], 50, None, "counts").cache()
    place = {r["id"]: (r["cell"], np.array(r["x"])) for r in cells.collect()}
    box = {r["cell"]: (np.array(r["low"]), np.array(r["high"])) for r in levels[-1].collect()}
    want = {(i, c) for i, (own, x) in place.items() for c, (low, high) in box.items()
            if c != own and (np.maximum(0, np.maximum(low - x, x - high)) ** 2).sum() <= 0.64}
    met = lambda places: [(r["id"], r["leaf"]) for r in density._guests(
        cells, home, doubt, 50, "w", "counts", [0.8], places).filter("visitor").collect()]
    every, first, rest = met((0, None)), met((0, 3)), met((3, None))
    assert sorted(every) == sorted(want) == sorted(first + rest) and len(first) <= 3 * 600
    assert len(want) < doubt.filter("a <> cell").count() * 20 / 2


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_distances_at_the_limit_count_as_the_plain_formula_has_it(spark, shift):
    """A lattice, where many pairs are as far apart as ``eps`` to the last bit or the one before it."""
    p = np.array([(i * 0.1 + shift, j * 0.1, k * 0.1) for i in range(9) for j in range(9) for k in range(9)])
    pdf = pd.DataFrame(p, columns=["c0", "c1", "c2"])
    got = np.stack(reach_of(spark, pdf, [0.1, 0.3], 10 ** 6, leaf_points=60))
    for i, e in enumerate((0.1, 0.3)):
        d = p[:, None, :] - p[None, :, :]
        near = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2] <= e * e
        assert (got[:, i] == np.where(near, near.sum(axis=1)[None, :], 0).max(axis=1)).all()
