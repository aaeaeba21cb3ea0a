"""Packing: whole results, gapless sequences, bounds that hold and counts near them."""

import itertools

import numpy as np
import pytest
from pyspark.errors import PySparkException

from gaugewarden.llm import packing


def optimum(sizes, capacity):
    """Fewest bins, by trying all ways."""
    best = len(sizes)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(sizes):
            best = len(free)
            return
        for j in {f: k for k, f in enumerate(free) if f >= sizes[i]}.values():
            free[j] -= sizes[i]
            place(i + 1, free)
            free[j] += sizes[i]
        place(i + 1, [*free, capacity - sizes[i]])

    place(0, [])
    return best


def test_bound_lies_between_volume_and_optimum():
    rng = np.random.default_rng(5)
    better = 0
    for _ in range(150):
        capacity = int(rng.integers(10, 40))
        sizes = sorted(rng.integers(1, capacity + 1, rng.integers(1, 9)).tolist(), reverse=True)
        counts = np.bincount(sizes, minlength=capacity + 1)
        volume, bound = -(-sum(sizes) // capacity), packing.lower_bound(counts, capacity)
        assert volume <= bound <= optimum(sizes, capacity)
        better += bound > volume
    assert better > 20


def test_best_fit_fills_without_gaps():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 101, 2_000)
    bins, offsets, fills = packing.best_fit(sizes, 100)
    for b in range(len(fills)):
        own = sorted(zip(offsets[bins == b], sizes[bins == b]))
        assert [o for o, _ in own] == list(itertools.accumulate([0, *(s for _, s in own)]))[:-1]
        assert sum(s for _, s in own) == fills[b] <= 100


def packed(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in groups.values():
        own.sort()
        assert [o for o, _ in own] == list(itertools.accumulate([0, *(n for _, n in own)]))[:-1] and sum(n for _, n in own) <= 100
    return len(groups)


def test_exchanges_close_gaps(spark):
    rng = np.random.default_rng(7)
    sizes = np.r_[rng.integers(20, 70, 1_500), rng.integers(1, 20, 1_500)].tolist()
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k int, length long")
    alone = packed(packing.pack(df, 100, part_items=100, max_rounds=0))
    exchanged = packed(packing.pack(df, 100, part_items=100))
    bound = packing.lower_bound(np.bincount(sizes, minlength=101), 100)
    assert bound <= exchanged < alone and exchanged <= bound * 1.02
    assert sorted(r.k for r in packing.pack(df, 100, part_items=100).collect()) == list(range(3_000))


def test_odd_items(spark):
    df = spark.createDataFrame([(1, 100, "x"), (1, 100, "x"), (None, 1, None)], "k int, length long, bin string")
    got = packing.pack(df, 100)
    assert packed(got) == 3 and got.columns == ["k", "length", "bin", "sequence_id", "offset"]
    assert packing.pack(df.limit(0), 100).count() == 0
    for wrong in (0, 101, None):
        with pytest.raises(PySparkException):
            packing.pack(spark.createDataFrame([(1, wrong)], "k int, length long"), 100).collect()
