from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugewarden.functions import quick_round
from gaugewarden.operators import neighbours

from .conftest import rows

D = date(2020, 1, 1)


def stations(n, seed, kind):
    """Spread out, a third at one spot, a third in one dense town, or all in a line."""
    rng = np.random.default_rng(seed)
    xy = rng.uniform(-3e5, 3e5, (n, 2))
    if kind == "copies":
        xy[: n // 3] = xy[0]
    if kind == "town":
        xy[: n // 3] = rng.normal(0, 30, (n // 3, 2)) + xy[0]
    if kind == "line":
        xy[:, 1] = 5.0
    return pd.DataFrame({"station_id": np.arange(n), "Lambert93x": xy[:, 0], "Lambert93y": xy[:, 1]})


def brute(pdf, k):
    x, y, ids = (pdf[c].to_numpy() for c in ("Lambert93x", "Lambert93y", "station_id"))
    out = {}
    for i in ids:
        km = np.sqrt((x[i] - x) ** 2 + (y[i] - y) ** 2) / 1000
        order = [j for j in np.lexsort((ids, km)) if j != i][:k]
        out[int(i)] = [(int(j), float(km[j])) for j in order]
    return out


@pytest.mark.parametrize("kind", ["spread", "copies", "town", "line"])
@pytest.mark.parametrize("n,k", [(4, 5), (240, 5)])
def test_nearest_neighbours_are_exact(spark, kind, n, k):
    pdf = stations(n, 3, kind)
    got = neighbours.nearest_neighbours(spark.createDataFrame(pdf), k).toPandas().sort_values(["station_id", "rank"])
    want = brute(pdf, k)
    for s, g in got.groupby("station_id"):
        assert g["neighbour_id"].tolist() == [j for j, _ in want[s]]
        np.testing.assert_allclose(g["km"], [d for _, d in want[s]])
    assert got["station_id"].nunique() == n


def test_crowds_do_not_bring_all_pairs(spark):
    """Candidates stay near linear in the stations even if a third of them share a spot or a town."""
    for kind in ("copies", "town"):
        pdf = stations(3000, 5, kind)
        df = neighbours.nearest_neighbours(spark.createDataFrame(pdf), 5)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_pairs_within_a_radius(spark):
    pdf = stations(120, 1, "town")
    got = neighbours.pairwise_distance(spark.createDataFrame(pdf), 60.0)
    want = [(i, j) for i, near in brute(pdf, 119).items() for j, km in near if km <= 60.0]
    assert rows(got, "station_id", "other_id") == sorted(want, key=repr)


@pytest.mark.parametrize("kind", ["spread", "copies", "town", "line"])
def test_pairs_of_blocks_are_exact(spark, monkeypatch, kind):
    """Blocks of a few stations, ids that repeat or are unknown and places that are unknown or no number."""
    monkeypatch.setattr(neighbours, "BLOCK", 7, raising=False)
    pdf = stations(150, 6, kind)
    pdf["station_id"] = pdf["station_id"] % 140
    pdf["h"] = np.arange(150.0)
    data = [tuple(v.item() for v in r) for r in pdf.to_records(index=False)] + [
        (None, 0.0, 0.0, 1.0), (900, None, 0.0, 1.0), (901, 0.0, float("nan"), 1.0)]
    got = neighbours.pairwise_distance(
        spark.createDataFrame(data, "station_id long, Lambert93x double, Lambert93y double, h double"), 50.0, attrs=["h"])
    assert got.columns == ["station_id", "other_id", "km", "h", "other_h"]
    want = []
    for i, x, y, h in data[:150]:
        for j, u, v, g in data[:150]:
            if i != j and (km := float(np.sqrt((x - u) * (x - u) + (y - v) * (y - v)) / 1000)) <= 50.0:
                want.append((i, j, km, h, g))
    assert rows(got, *got.columns) == sorted(want, key=repr)


@pytest.mark.parametrize("kind", ["copies", "town"])
def test_pairs_spread_over_tasks(spark, monkeypatch, kind):
    """The pairs of a crowded place are made by many tasks, as many as the pairs ask for."""
    monkeypatch.setattr(neighbours, "BLOCK", 32, raising=False)
    monkeypatch.setattr(neighbours, "TASK_PAIRS", 10_000, raising=False)
    got = neighbours.pairwise_distance(spark.createDataFrame(stations(1200, 7, kind)), 50.0)
    by_task = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(by_task) >= 8 and max(by_task) < sum(by_task) / 4


@pytest.mark.parametrize("kind", ["spread", "copies", "line"])
def test_strips_of_blocks_are_exact(spark, monkeypatch, kind):
    """Both orders of every pair once, whether a strip is full, the rest of a block or one station."""
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    monkeypatch.setattr(neighbours, "STRIP", 3, raising=False)
    pdf = stations(130, 8, kind)
    got = neighbours.pairwise_distance(spark.createDataFrame(pdf), 70.0)
    want = sorted(((i, j, km) for i, near in brute(pdf, 129).items() for j, km in near if km <= 70.0), key=repr)
    got = rows(got, "station_id", "other_id", "km")
    assert [r[:2] for r in got] == [r[:2] for r in want]
    np.testing.assert_allclose([r[2] for r in got], [r[2] for r in want])


def test_written_pairs_are_small(spark, tmp_path):
    """Ids in runs and repeated distances: 5.5 bytes a row here, and 8.2 with the orders in turn."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"station_id": np.arange(4000), "Lambert93x": rng.uniform(0, 150e3, 4000), "Lambert93y": rng.uniform(0, 150e3, 4000)})
    neighbours.pairwise_distance(spark.createDataFrame(pdf), 50.0).write.parquet(str(tmp_path / "pairs"))
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert size / spark.read.parquet(str(tmp_path / "pairs")).count() < 6.5


def test_quick_round_is_round(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.uniform(-100, 100, 20_000), rng.uniform(-1e13, 1e13, 500), rng.uniform(-1e-5, 1e-5, 500),
                             (rng.integers(-10**9, 10**9, 5_000) * 2 + 1) / 2e6, rng.integers(-10**6, 10**6, 500) / 1e6])
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 5e-7, -5e-7, 1e300, 999999.9999995]
    df = spark.createDataFrame([(v,) for v in [*values.tolist(), *odd]], "v double")
    both = df.select("v", quick_round("v", 6).alias("a"), F.round("v", 6).alias("b"))
    assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).collect() == []


def test_neighbour_lags_need_exactly_one_match(spark):
    df = spark.createDataFrame([(1, D, 1.0), (1, D + timedelta(days=3), 2.0), (2, D, 5.0), (2, D + timedelta(days=2), 6.0),
                                (2, D + timedelta(days=2), 7.0)], "station_id int, day date, TN double")
    near = spark.createDataFrame([(1, 2, 1)], "station_id int, neighbour_id int, rank int")
    out = neighbours.neighbour_lag_features(df, near, ["TN"], 1, 3).filter("station_id = 1").orderBy("day").collect()
    assert [(r["TN_j1_t1"], r["TN_j1_t2"], r["TN_j1_t3"]) for r in out] == [(None, None, None), (None, None, 5.0)]


def lives(seed, n=25, days=60):
    """Measured days of stations that open and close at random, with holes."""
    rng = np.random.default_rng(seed)
    out = []
    for s in range(n):
        first, last = sorted(rng.integers(0, days, 2))
        out += [(s, D + timedelta(days=int(d))) for d in range(first, last + 1) if d in (first, last) or rng.random() > 0.3]
    return pd.DataFrame(out, columns=["station_id", "day"])


@pytest.mark.parametrize("pool", [1, 2, 10])
def test_active_neighbours_daily(spark, pool):
    """Exact for any pool: the pool only decides how much is settled without a second search."""
    pdf, st = lives(2), stations(25, 2, "spread")
    span = pdf.groupby("station_id")["day"].agg(["min", "max"])
    near = brute(st, 24)
    want = []
    for s, d in zip(pdf["station_id"], pdf["day"]):
        active = [j for j, _ in near[s] if j in span.index and span.loc[j, "min"] <= d < span.loc[j, "max"]][:3]
        want += [(s, d, i + 1, j) for i, j in enumerate(active)]
    got = neighbours.active_neighbours_daily(spark.createDataFrame(pdf), spark.createDataFrame(st), 3, pool)
    assert rows(got, "station_id", "day", "rank", "neighbour_id") == sorted(want, key=repr)


@pytest.mark.parametrize("pool", [1, 10])
def test_active_intervals_follow_the_walk(spark, pool):
    """Day by day against a plain walk; at some times fewer than three stations are open, or none."""
    pdf, st = lives(5, 18), stations(25, 5, "spread")
    span = pdf.groupby("station_id")["day"].agg(["min", "max"])
    near, want = brute(st, 24), []
    for s in span.index:
        day = span.loc[s, "min"]
        while day < span.loc[s, "max"]:
            active = [j for j, _ in near[s] if j in span.index and span.loc[j, "min"] <= day < span.loc[j, "max"]][:3]
            if not active:
                day += timedelta(days=1)
                continue
            end = min(span.loc[j, "max"] for j in active)
            want += [(s, day, end, i + 1, j) for i, j in enumerate(active)]
            day = end + timedelta(days=1)
    got = neighbours.active_neighbour_intervals(spark.createDataFrame(pdf), spark.createDataFrame(st), 3, pool)
    assert rows(got, "station_id", "seg_start", "seg_end", "rank", "neighbour_id") == sorted(want, key=repr)


def test_active_intervals_cover_a_life_without_overlap(spark):
    pdf, st = lives(4), stations(25, 4, "spread")
    span = pdf.groupby("station_id")["day"].agg(["min", "max"])
    got = neighbours.active_neighbour_intervals(spark.createDataFrame(pdf), spark.createDataFrame(st)).toPandas()
    near = brute(st, 24)
    assert len(got)
    for s, g in got.groupby("station_id"):
        segments = g.groupby("seg_start")
        assert g["seg_start"].min() >= span.loc[s, "min"]
        ends = None
        for start, seg in segments:
            assert ends is None or start > ends
            ends = seg["seg_end"].iloc[0]
            active = [j for j, _ in near[s] if j in span.index and span.loc[j, "min"] <= start < span.loc[j, "max"]][:3]
            assert seg.sort_values("rank")["neighbour_id"].tolist() == active
            assert ends == min(span.loc[j, "max"] for j in active)


def test_attached_values_come_from_the_day(spark):
    df = spark.createDataFrame([(1, D, 1.0), (2, D, 2.0), (3, D, 3.0)], "station_id int, day date, TN double")
    active = spark.createDataFrame([(1, D, 1, 3), (1, D, 2, 2)], "station_id int, day date, rank int, neighbour_id int")
    out = neighbours.attach_active_neighbours(df, active, ["TN"], 2).filter("station_id = 1").first()
    assert (out["TN_0"], out["TN_1"]) == (3.0, 2.0)


def test_long_stretches_meet_few_measured_days(spark):
    """A row per span of days, not per day, and never sent to all tasks: the driver holds nothing that grows with a station's life."""
    end = D + timedelta(days=30_000)
    stretches = spark.createDataFrame([(1, D, D + timedelta(days=9_999), "a"), (1, D + timedelta(days=10_000), end, "b"), (2, D, D, "c")],
                                      "station_id long, seg_start date, seg_end date, near string")
    days = [(1, D), (1, D + timedelta(days=9_999)), (1, D + timedelta(days=10_000)), (1, end), (1, end + timedelta(days=1)), (2, D), (3, D)]
    met = neighbours._days_within(spark.createDataFrame(days, "station_id long, day date"), stretches)
    assert rows(met, "station_id", "day", "near") == sorted(((s, d, n) for (s, d), n in zip(days, "aabb-c-") if n != "-"), key=repr)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    df = spark.createDataFrame([(s, d) for s in range(6) for d in (D, D + timedelta(days=9_000), end)], "station_id long, day date")
    places = spark.createDataFrame([(s, float(s * s), 0.0) for s in range(6)], "station_id long, Lambert93x double, Lambert93y double")
    active = neighbours.active_neighbours_daily(df, places, 2, 1)
    assert "sequence(seg_start#" not in active._jdf.queryExecution().executedPlan().toString()
    near = {0: [1, 2], 1: [0, 2], 2: [1, 0], 3: [2, 4], 4: [3, 5], 5: [4, 3]}
    assert rows(active, "station_id", "day", "rank", "neighbour_id") == sorted(
        ((s, d, r + 1, n) for s in range(6) for d in (D, D + timedelta(days=9_000)) for r, n in enumerate(near[s])), key=repr)


def test_pairs_without_a_radius_are_all_pairs(spark, monkeypatch):
    """Every two stations in both orders, however far; ids that repeat or are unknown and places that are unknown."""
    monkeypatch.setattr(neighbours, "BLOCK", 10)
    monkeypatch.setattr(neighbours, "STRIP", 3)
    monkeypatch.setattr(neighbours, "TASK_PAIRS", 1000)
    pdf = stations(110, 10, "town")
    pdf["station_id"] = pdf["station_id"] % 100
    data = [tuple(v.item() for v in r) for r in pdf.to_records(index=False)] + [(None, 0.0, 0.0), (900, None, 0.0), (901, 1.0, None)]
    df = spark.createDataFrame(data, "station_id long, Lambert93x double, Lambert93y double")
    got = neighbours.pairwise_distance(df)
    want = [(i, j, None if None in (x, y, u, v) else float(np.sqrt((x - u) * (x - u) + (y - v) * (y - v)) / 1000))
            for i, x, y in data for j, u, v in data if None not in (i, j) and i != j]
    assert rows(got, "station_id", "other_id", "km") == sorted(want, key=repr)
    by_task = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(by_task) >= 4 and max(by_task) < len(want) / 2
    assert neighbours.pairwise_distance(df.limit(0)).count() == 0


def test_the_registered_distances_have_no_radius(spark, sf_dir):
    from gaugewarden import fixtures
    from gaugewarden.catalogue import QUERIES

    n = fixtures.stations(spark, sf_dir).count()
    assert QUERIES["pairwise_distance"](spark, sf_dir).count() == n * (n - 1)
