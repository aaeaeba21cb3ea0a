"""Exact clustering against plain integer loops."""

import hashlib
import math

import numpy as np
import pytest

from gaugewarden.llm import centroids


def plain(rows, dimensions, k, rounds):
    """Clusters and distances of the usable rows, centroids; Python integers throughout."""
    usable = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows
              if v is not None and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted(usable, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    middle = [v for _, v in start[:k]]
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))

    def assign():
        return [min((gap(v, c), n) for n, c in enumerate(middle)) for _, v in usable]

    for _ in range(rounds):
        own = assign()
        for n in range(len(middle)):
            members = [v for (_, v), (_, at) in zip(usable, own) if at == n]
            if members:
                middle[n] = [sum(col) // len(members) for col in zip(*members)]
    return sorted(((i, n, d) for (i, _), (d, n) in zip(usable, assign())), key=str), middle


def test_knockout_takes_the_nearest_and_the_smaller_of_equals():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 7, 40):
        c = rng.integers(-3, 4, (k, 3))
        c[-1] = c[0]
        x = rng.integers(-4, 5, (500, 3))
        wanted = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (centroids.Bisectors(c).nearest(x) == wanted).all()


@pytest.mark.parametrize("k,rounds", [(3, 5), (40, 2), (5, 0)])
def test_clusters_agree_with_plain_loops(spark, k, rounds):
    rng = np.random.default_rng(k)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(300)]
    rows += [(7, [0.5] * 4), (7, [-0.25] * 4), (None, [0.1, 0.2, 0.3, 0.4])]
    rows += [(1_000 + i, [0.125] * 4) for i in range(150)]  # a third at one place
    rows += [(5_000, None), (5_001, []), (5_002, [1.0] * 3), (5_003, [1.0, None, 0.0, 0.0]), (5_004, [float("nan")] * 4),
             (5_005, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(5)
    found, final = centroids.cluster_vectors(df, dimensions=4, k=k, rounds=rounds)
    got, (wanted, middle) = found.collect(), plain(rows, 4, k, rounds)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == wanted
    assert final.tolist() == middle
    for r in got:
        assert r.cluster_inertia == sum(d for _, n, d in wanted if n == r.cluster)
        assert r.inertia == sum(d for *_, d in wanted)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    found, final = centroids.cluster_vectors(df, dimensions=2)
    assert final.tolist() == [[256, 512]] * 2
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0)]
    assert centroids.cluster_vectors(df.limit(0), dimensions=2)[0].collect() == []
    assert centroids.cluster_vectors(df, dimensions=3)[0].collect() == []


def test_components_beyond_exact_arithmetic_are_refused(spark):
    df = spark.createDataFrame([(1, [1e9, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_vectors(df, dimensions=2)
