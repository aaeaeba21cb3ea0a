"""Vector links against all cosines in double precision."""

import numpy as np
import pytest

from gaugewarden.llm import vector_dedup

from .test_duplicates import roots

SCHEMA = "vec_id long, embedding array<double>, label int, node string, rep int, stripe string"


def table(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], c, "clash", 1, "clash")
                                  for k, v, c in rows], SCHEMA)


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 40)) * np.exp(rng.normal(size=(300, 40)) * 2)
    x[150:] = x[:150] + rng.normal(size=(150, 40)) * 0.2 * np.abs(x[:150]).mean(axis=1, keepdims=True)
    q = vector_dedup.quantised(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for threshold in (0.3, 0.8, 0.93, 0.999):
        i, j = vector_dedup.possible_pairs(q, q, threshold)
        assert set(zip(*np.nonzero(unit @ unit.T >= threshold))) <= set(zip(i, j))
    assert len(vector_dedup.possible_pairs(q, q, 0.93)[0]) < 2 * (unit @ unit.T >= 0.9).sum() + 300


def expected(rows, threshold):
    good = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float)), c, len(v)) for i, (k, v, c) in enumerate(rows)
            if k is not None and c is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a[0], b[0]) for n, a in enumerate(good) for b in good[:n] if a[2:] == b[2:] and a[1] @ b[1] >= threshold]
    root = roots(range(len(rows)), links)
    out = []
    for i, (k, _, _) in enumerate(rows):
        own = [rows[j][0] for j in root if root[j] == root[i]]
        out.append((k, sum(i in pair for pair in links), min(own) if None not in own else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("stripe_rows", [5, 16, 10_000])
def test_links_and_components(spark, stripe_rows):
    rng = np.random.default_rng(2)
    rows = []
    centres = rng.normal(size=(12, 8))
    for i in range(150):
        v = centres[i % 12] + rng.normal(size=8) * 0.25
        rows.append((int(i), v.tolist(), 0 if i % 3 else int(i % 2)))
    rows += [(1_000 + i, rows[7][1], rows[7][2]) for i in range(30)]  # a crowd of equal vectors
    rows += [(2_000 + i, (centres[0] + rng.normal(size=8) * 0.01).tolist(), 0) for i in range(40)]  # and one of near ones
    rows += [(3_000, None, 0), (3_001, [0.0] * 8, 0), (3_002, [1.0, None] * 4, 0), (3_003, [float("nan")] * 8, 0),
             (3_004, [float("inf")] * 8, 0), (3_005, [1.0] * 8, None), (3_006, [1.0] * 8, None), (3_007, [], 0), (None, [1.0] * 8, 0),
             (3_008, [1.0] * 8, 0), (3_009, [2.0] * 8, 0), (3_010, [1.0] * 4, 0), (3_011, [1.0] * 4, 0), (3_012, [1e-200] * 8, 0)]
    df = table(spark, rows).repartition(4)
    got = vector_dedup.near_duplicate_vectors(df, 0.93, stripe_rows=stripe_rows).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == expected(rows, 0.93)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_duplicate_vectors(table(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]
    assert vector_dedup.near_duplicate_vectors(table(spark, rows).limit(0)).count() == 0
