"""Quantiles, scaling, metrics and choices."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugewarden.operators import evaluate, labels, profile, scale
from gaugewarden.operators.quantiles import SKETCHED, bracket_counts, exact_quantiles, quantiles_exact

from .conftest import rows

QS = [0.0, 0.005, 0.25, 0.5, 0.9, 0.995, 1.0]


@pytest.mark.parametrize("kind", ["normal", "heavy", "copies", "constant", "few"])
def test_quantiles_beyond_the_sketch_size_are_exact(spark, kind):
    rng = np.random.default_rng(1)
    n = 4 * SKETCHED
    v = {"normal": rng.normal(size=n), "heavy": np.exp(rng.normal(size=n) * 4),
         "copies": np.where(rng.random(n) < 0.34, 1.5, rng.normal(size=n)), "constant": np.full(n, 2.0),
         "few": rng.integers(0, 7, n).astype(float)}[kind]
    got = exact_quantiles(spark.createDataFrame(pd.DataFrame({"v": v})).repartition(8), "v", QS).toPandas()
    np.testing.assert_allclose(got.sort_values("q")["quantile"], np.quantile(v, QS), rtol=1e-12)


def test_quantiles_per_group_ignore_nulls(spark):
    pdf = pd.DataFrame({"g": ["a"] * 5 + ["b"] * 3 + ["c"], "v": [1, 2, 4, None, 9, 7, 7, 8, None]})
    got = exact_quantiles(spark.createDataFrame(pdf).replace(float("nan"), None), "v", [0.5, 0.9], ["g"])
    assert rows(got) == [("a", 0.5, 3.0), ("a", 0.9, pytest.approx(7.5)), ("b", 0.5, 7.0), ("b", 0.9, pytest.approx(7.8))]


def test_quantiles_of_nothing(spark):
    assert quantiles_exact(spark.createDataFrame([], "a double, b double"), ["a", "b"], [0.5]).collect() == []


def test_only_values_near_a_quantile_are_ranked(spark):
    """What reaches the ranking is a small part of the rows."""
    df = spark.range(8 * SKETCHED).select(F.rand(1).alias("v"))
    out = exact_quantiles(df, "v", [0.5])
    assert out.first()["quantile"] == pytest.approx(0.5, abs=0.01)
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()


KINDS = {
    "normal": lambda rng, n: rng.normal(size=n), "heavy": lambda rng, n: np.exp(rng.normal(size=n) * 9),
    "halves": lambda rng, n: np.where(rng.random(n) < 0.5, rng.choice([1.0, 3.0], n), 1 + 2 * rng.random(n)),
    "few": lambda rng, n: rng.integers(0, 4, n).astype(float), "constant": lambda rng, n: np.full(n, 2.0)}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_brackets_are_narrowed_until_they_are_small(spark, kind):
    """A coarse sketch and a small bound: several rounds, the same result, and as many rows to rank at ten times the rows."""
    largest = {}
    for n in (4_000, 40_000):
        v = KINDS[kind](np.random.default_rng(n), n)
        df = spark.createDataFrame(pd.DataFrame({"g": np.arange(n) % 2, "v": v})).repartition(8).cache()
        got = exact_quantiles(df, "v", QS, ["g"], accuracy=200, ranked=60).toPandas().sort_values(["g", "q"])
        for g in (0, 1):
            np.testing.assert_allclose(got.loc[got["g"] == g, "quantile"], np.quantile(v[g::2], QS), rtol=1e-12)
        largest[n] = max(r["count"] for r in bracket_counts(df, "v", QS, ["g"], accuracy=200, ranked=60).groupBy("g").count().collect())
        df.unpersist()
    # seven fractions, at most two slots each, 60 rows a slot and one null row between slots
    assert max(largest.values()) <= 2 * len(QS) * 61


def test_standardise_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(v, 3.0) for v in (1.0, 2.0, 4.0)], "a double, b double")
    got = rows(scale.standardise(df, ["a", "b"]))
    want = (np.array([1, 2, 4]) - 7 / 3) / np.std([1, 2, 4])
    np.testing.assert_allclose(sorted(a for a, _ in got), np.sort(want))
    assert {b for _, b in got} == {0.0}


def test_training_statistics_and_the_way_back(spark):
    df = spark.createDataFrame([(1.0, 5.0, True), (3.0, 5.0, True), (9.0, 6.0, False)], "a double, b double, t boolean")
    z = scale.zscore_train_stats(df, ["a", "b"], F.col("t"))
    assert rows(z, "a", "b")[-1] == (pytest.approx(7 / np.std([1, 3], ddof=1)), 1.0)
    stats = scale.minmax_stats(df.filter("t"), ["a", "b"])
    scaled = scale.minmax_apply(df, stats, ["a", "b"])
    assert rows(scaled, "a", "b") == [(0.0, 0.0), (1.0, 0.0), (4.0, 1.0)]
    assert rows(scale.minmax_inverse(scaled, stats, ["a", "b"])) == rows(df)


# Published confusion counts (TP, TN, FP, FN) and their accuracy, recall, precision, roc, mcc.
PUBLISHED = [
    ((3310, 475443, 458711, 1774), (0.5097249046567537, 0.6510621557828482, 0.0071641765201148, 0.5800089262975756, 0.0234850579849145)),
    ((2067, 701708, 232446, 3017), (0.7493042232107304, 0.4065696302124311, 0.008814010310729, 0.5788695687977911, 0.026739801041847)),
    ((4742, 116738, 817416, 342), (0.129338889610514, 0.9327301337529504, 0.0057677478051664, 0.5288483405122997, 0.0128157445044549)),
]


@pytest.mark.parametrize("counts,want", PUBLISHED)
def test_published_metrics(spark, counts, want):
    df = spark.createDataFrame([counts], "TP long, TN long, FP long, FN long")
    got = evaluate.metrics_from_counts(df).first()
    assert [got[m] for m in ("accuracy", "recall", "precision", "roc", "mcc")] == pytest.approx(list(want), rel=1e-9)


def test_nothing_predicted_gives_zeros(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "real int, pred int")
    got = evaluate.classification_metrics(df, "real", "pred").first()
    assert (got["precision"], got["recall"], got["f1"], got["mcc"], got["accuracy"]) == (0, 0, 0, 0, 0.5)


def test_best_candidate_has_the_highest_recall_that_is_accurate_enough(spark):
    df = spark.createDataFrame([("a", 0.75, 0.40), ("b", 0.71, 0.41), ("c", 0.5, 0.9)], "c string, accuracy double, recall double")
    assert evaluate.select_best_candidate(df).first()["c"] == "b"


def test_vote_skips_absent_detectors(spark):
    df = spark.createDataFrame([(1, None, 1), (0, None, None)], "a int, b int, c int")
    assert rows(labels.detector_vote(df, ["a", "b", "c"]), "votes") == [(0,), (2,)]


def test_small_residuals_are_suppressed_only_in_predicted_rows(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 1.05), (1, 1, 1.0, 2.0), (0, 1, 1.0, 1.0)],
                               "anomaly_pred int, ETP_anomaly_pred int, ETP_origine double, ETP_pred double")
    got = labels.suppress_small_residuals(df, ["ETP"], [0.09]).select("anomaly_pred", "ETP_anomaly_pred").collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 1), (1, 1)]


def test_histograms_close_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 4)], "v double")
    assert rows(profile.histogram_fixed_bins(df, "v", 4)) == [(0, 1), (1, 1), (2, 1), (3, 3)]
    assert rows(profile.histogram_by_edges(df, F.col("v"), [0, 2, 4])) == [(0, 2), (1, 4)]
    assert rows(profile.histogram_fixed_bins(df.filter("v = 4"), "v", 2)) == [(0, 2), (1, 0)]


def test_box_of_one_group(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double")
    got = profile.box_stats(df, "v").first()
    assert (got["q50"], got["whisker_high"], got["outliers"]) == (3.0, 4.0, 1)


def test_correlation_ignores_incomplete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, 8.0)], "a double, b double")
    assert {(r["col_a"], r["col_b"]): round(r["corr"], 9) for r in profile.correlation_matrix(df, ["a", "b"]).collect()} == {
        ("a", "a"): 1.0, ("a", "b"): 1.0, ("b", "b"): 1.0}


def test_p_values():
    """With two degrees of freedom the probability is one minus the coefficient; large samples are normal."""
    assert profile.pearson_p_value(0.3, 4) == pytest.approx(0.7, abs=1e-6)
    assert profile.pearson_p_value(0.5, 10) == pytest.approx(0.14111, abs=1e-4)
    assert profile.pearson_p_value(0.02, 10_000) == pytest.approx(profile.pearson_p_value(0.02, 10_005), rel=0.01)
    assert profile.pearson_p_value(1.0, 9) == 0.0 and profile.pearson_p_value(0.9, 2) == 1.0


def test_extremes_over_missed_and_false_anomalies(spark):
    df = spark.createDataFrame([(1, 0, 5.0, 4.0, -2.0), (0, 1, 9.0, 2.0, 0.5), (1, 1, 1.0, 99.0, 50.0)],
                               "anomaly int, anomaly_pred int, TN double, TN_pred double, TN_difference double")
    assert rows(evaluate.error_residual_extremes(df, ["TN"])) == [("FN", "TN", 1.0, 2.0), ("FP", "TN", 7.0, 0.5)]


def test_years_and_stations(spark):
    df = spark.createDataFrame([(1, date(2020, 1, 1)), (1, date(2021, 1, 1)), (2, date(2021, 5, 1))], "station_id int, day date")
    assert rows(profile.stations_per_year(df)) == [(2020, 1), (2021, 2)]
    assert rows(profile.stations_per_year(df, approx=True)) == [(2020, 1), (2021, 2)]
    assert rows(profile.distinct_years_per_station(df)) == [(1, 2), (2, 1)]
