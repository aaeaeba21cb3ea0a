from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugewarden.operators import sampling, series

from .conftest import rows

START = date(2019, 12, 1)


@pytest.fixture()
def small_blocks(monkeypatch):
    """Blocks of seven rows, so that series cross many of them."""
    monkeypatch.setattr(series, "BLOCK", 7)


def make(seed=0, stations=4, length=90, hole=0.15):
    """Series across a new year with holes; station 0 is much longer than the others."""
    rng = np.random.default_rng(seed)
    out = []
    for s in range(stations):
        for d in range(length * (6 if s == 0 else 1)):
            if rng.random() > hole:
                out.append((s, START + timedelta(days=d), float(np.round(rng.normal(), 3))))
    return pd.DataFrame(out, columns=["station_id", "day", "v"])


def test_positions(spark, small_blocks):
    pdf = make()
    got = series.series_positions(spark.createDataFrame(pdf)).toPandas().sort_values(["station_id", "day"])
    assert (got["pos"].to_numpy() == pdf.groupby("station_id").cumcount().to_numpy() + 1).all()
    assert (got["n"].to_numpy() == pdf.groupby("station_id")["v"].transform("size").to_numpy()).all()


@pytest.mark.parametrize("n", [1, 5, 7, 11])
def test_lags(spark, small_blocks, n):
    pdf = make()
    got = series.lag_features(spark.createDataFrame(pdf), ["v"], n).toPandas().sort_values(["station_id", "day"])
    for i in range(1, n + 1):
        want = pdf.groupby("station_id")["v"].shift(i).to_numpy()
        np.testing.assert_array_equal(got[f"v_{i}"].to_numpy(dtype=float), want)


def test_breaks_trim_each_run(spark, small_blocks):
    pdf = make(hole=0.08)
    starts = pdf.groupby("station_id")["day"].diff().map(lambda d: d != timedelta(days=1))
    run = starts.cumsum()
    kept = pdf[pdf.groupby(run).cumcount() >= 5]
    got = series.series_breaks(spark.createDataFrame(pdf)).select("station_id", "day", "run_key")
    assert rows(got, "station_id", "day") == sorted(zip(kept["station_id"], kept["day"]), key=repr)
    assert got.select("station_id", "run_key").distinct().count() == run[kept.index].nunique()


def test_sequences(spark, small_blocks):
    pdf = make(stations=2, length=30)
    got = {(r["station_id"], r["day"]): ([x["v"] for x in r["x"]], r["y"]["v"])
           for r in series.sequence_windows(spark.createDataFrame(pdf), ["v"], 9).collect()}
    want = {}
    for s, g in pdf.groupby("station_id"):
        v, d = g["v"].tolist(), g["day"].tolist()
        want.update({(s, d[i]): (v[i - 9:i], v[i]) for i in range(9, len(v))})
    assert got == want


def test_contiguous_sequences_have_no_hole(spark, small_blocks):
    pdf = make()
    days = {s: set(g["day"]) for s, g in pdf.groupby("station_id")}
    got = series.sequence_windows(spark.createDataFrame(pdf), ["v"], 4, contiguous=True)
    want = [(s, d) for s in days for d in days[s] if all(d - timedelta(days=i) in days[s] for i in range(1, 5))]
    assert rows(got, "station_id", "day") == sorted(want, key=repr)


def test_input_and_label_windows(spark, small_blocks):
    pdf = make(stations=1, length=8, hole=0.0)
    got = series.input_label_windows(spark.createDataFrame(pdf), ["v"], 24, 5, 24).orderBy("first_day").collect()
    v = pdf["v"].tolist()
    assert len(got) == len(v) - 47
    assert [[x["v"] for x in r["inputs"]] for r in got] == [v[i:i + 24] for i in range(len(v) - 47)]
    assert [[x["v"] for x in r["labels"]] for r in got] == [v[i + 43:i + 48] for i in range(len(v) - 47)]


def test_multi_series_windows_run_over_the_grid(spark):
    pdf = pd.DataFrame([(1, START, 1.0, 7.0), (1, START + timedelta(days=2), 3.0, 7.0), (2, START + timedelta(days=1), 5.0, 8.0)],
                       columns=["station_id", "day", "v", "alt"])
    out = series.multi_series_windows(spark.createDataFrame(pdf), ["v"], [], 2, 1, 1, static=["alt"])
    got = {r["station_id"]: (r["alt"], [x["v"] for x in r["inputs"]], [x["v"] for x in r["labels"]]) for r in out.collect()}
    assert got == {1: (7.0, [1.0, None], [3.0]), 2: (8.0, [None, 5.0], [None])}


def test_split_by_position_is_exact(spark):
    pdf = make(stations=3)
    out = series.split_by_position(spark.createDataFrame(pdf)).toPandas()
    for _, g in out.groupby("station_id"):
        n = len(g)
        sizes = g["split"].value_counts()
        assert sizes["train"] == int(n * 0.7) and sizes["train"] + sizes["val"] == int(n * 0.9)
        assert g[g["split"] == "train"]["day"].max() < g[g["split"] == "val"]["day"].min()


@pytest.mark.parametrize("n", [0, 1, 17, 500, 900])
def test_samples_have_the_exact_size(spark, n):
    st = spark.range(500).withColumnRenamed("id", "station_id")
    first = {r[0] for r in sampling.sample_stations(st, n, seed=7).collect()}
    assert len(first) == min(n, 500)
    assert first == {r[0] for r in sampling.sample_stations(st.repartition(5), n, seed=7).collect()}


@pytest.mark.parametrize("positives", [0, 3, 60])
def test_balanced_sample(spark, positives):
    df = spark.range(100).withColumn("label", (F.col("id") < positives).cast("int"))
    out = sampling.balanced_sample(df, "label", key=["id"]).groupBy("label").count().collect()
    counts = {r["label"]: r["count"] for r in out}
    assert counts.get(1, 0) == positives and counts.get(0, 0) == min(positives, 100 - positives)


def test_sample_fraction_keeps_what_it_must(spark):
    df = spark.range(20000).withColumn("hit", F.col("id") % 10 == 0)
    out = sampling.sample_fraction(df, 0.2, keep=F.col("hit"), key=["id"])
    assert out.filter("hit").count() == 2000
    assert abs(out.filter("NOT hit").count() / 18000 - 0.2) < 0.02


def test_year_and_station_split(spark):
    df = spark.createDataFrame([(s, date(y, 1, 1)) for s in range(40) for y in range(2010, 2025)], "station_id int, day date")
    out = sampling.split_by_year_station(df, list(range(2010, 2021)), [2021, 2022])
    count = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert count == {"test": 40 * 2, "val": 40 * 2 + 4 * 11, "train": 36 * 11}


@pytest.mark.parametrize("edge", [0, 40])
def test_cutoff_is_the_hash_at_the_quota(spark, edge):
    """Whatever few hashes are looked at in the end; rows of one key share a hash, a third of all rows here."""
    df = spark.createDataFrame([(i if i % 3 else 0,) for i in range(3_000)], "id long")
    hashes = sorted(r[0] for r in df.select(sampling.hash_order(9, "id")).collect())
    for quota in (1, 700, 3_000):
        assert sampling.hash_cutoff(df, ["id"], quota, 9, edge) == hashes[quota - 1]
    assert sampling.hash_cutoff(df, ["id"], 3_001, 9, edge) == sampling.ALL
    assert sampling.hash_cutoff(df, ["id"], 0, 9, edge) == sampling.NONE
