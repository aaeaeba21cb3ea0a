"""Clusters of integer vectors around centroids, every comparison exact.

Of two centroids the nearer one follows from the sign of a linear function:
``x . 2 (b - a) - (|b|^2 - |a|^2)`` is above zero exactly if ``x`` lies nearer
to ``b``. Normals and thresholds of all pairs are worked out once per task;
each vector then goes through a knockout of ``k - 1`` sign tests in which zero
favours the smaller number, and only the distance to the winner is computed.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage_table

K = 40
ROUNDS = 5
SCALE = 256
#: Largest component, so that products, sums and distances of up to ``DIMENSIONS`` components fit 64 bits.
LARGEST = 1 << 26
DIMENSIONS = 256
#: Normals of all pairs take k * k * dimensions * 8 bytes in a task.
MOST_CENTROIDS = 512
BLOCK = 4_096


class Bisectors:
    """Normals and thresholds of all pairs of ``centroids`` (rows of integers)."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids if len(centroids) else np.zeros((1, centroids.shape[1]), np.int64)
        centroids = self.centroids
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])  # [a, b]: from a towards b
        squares = (centroids * centroids).sum(axis=1)
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each row; of equally near ones the smaller number.

        Every round halves the field. The order of (distance, number) is total, so the knockout's shape does not matter.
        """
        field = np.broadcast_to(np.arange(len(self.centroids)), (len(x), len(self.centroids)))
        while field.shape[1] > 1:
            winners = []
            for i in range(0, field.shape[1] - 1, 2):
                a, b = np.minimum(field[:, i], field[:, i + 1]), np.maximum(field[:, i], field[:, i + 1])
                if field.strides[0] == 0:  # the first round: the same pair for all rows
                    side = x @ self.normals[a[0], b[0]]
                else:
                    side = np.einsum("nd,nd->n", x, self.normals[a, b])
                winners.append(np.where(side > self.thresholds[a, b], b, a))
            if field.shape[1] % 2:
                winners.append(field[:, -1])
            field = np.stack(winners, axis=1)
        return field[:, 0]

    def distance(self, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        gap = x - self.centroids[number]
        return (gap * gap).sum(axis=1)


def integer_vectors(df: DataFrame, key: str, vector: str, dimensions: int, scale: int = SCALE) -> DataFrame:
    """Rows (key, x) with ``x`` = floor(scale * component); vectors of other lengths, or with null or non-finite components, are left out.

    A component beyond ``LARGEST`` after scaling is refused with an error, as its distances would not be exact in 64 bits.
    """
    v = F.col(vector)
    usable = (F.size(v) == dimensions) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    fits = F.forall("x", lambda c: F.abs(c) <= LARGEST)
    kept = df.where(F.coalesce(usable, F.lit(False))).select(F.col(key).alias("key"), whole.alias("x"))
    return kept.select("key", F.when(fits, F.col("x").cast("array<int>")).otherwise(
        F.raise_error(F.lit(f"a scaled component is beyond {LARGEST}"))).alias("x"))


def _blocks(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[int, np.ndarray]]:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    for at in range(0, len(flat), BLOCK):
        yield at, flat[at:at + BLOCK].astype(np.int64)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, rows, exact sum of each component) of the non-empty clusters; a task sends one row per cluster."""
    k, dimensions = max(1, len(centroids)), centroids.shape[1]

    def add(batches):
        bisectors, counts, sums = Bisectors(centroids), np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for _, x in _blocks(batch, dimensions):
                own = bisectors.nearest(x)
                counts += np.bincount(own, minlength=k)
                by = np.argsort(own, kind="stable")
                some, first = np.unique(own[by], return_index=True)
                sums[some] += np.add.reduceat(x[by], first, axis=0)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": met.astype(np.int32), "n": counts[met], "s": list(sums[met])},
                                         pa.schema({"cluster": pa.int32(), "n": pa.int64(), "s": pa.list_(pa.int64())}))

    parts = vectors.select("x").mapInArrow(add, "cluster int, n long, s array<long>")
    exact = [F.sum(F.element_at("s", i + 1).cast("decimal(38,0)")) for i in range(dimensions)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*exact).alias("s")).collect()  # at most k rows


def first_centroids(vectors: DataFrame, k: int, seed: int, dimensions: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``<seed>:<key>``; rows of one key follow their components, null keys come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = vectors.orderBy(order.asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in first], np.int64).reshape(len(first), dimensions)


def cluster_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = 64, k: int = K,
                    rounds: int = ROUNDS, seed: int = 2, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance, cluster_inertia, inertia) of every usable vector, and the final centroids.

    Each of ``rounds`` rounds assigns every vector to its nearest centroid
    (squared distance, then smaller number) and replaces each non-empty
    centroid by the floor of the mean, component by component; then vectors are
    assigned once more. ``cluster_inertia`` sums the distances of a cluster, ``inertia`` of all.

    Vectors that are null, of another length or with null or non-finite
    components are left out. Repeated rows count as often as they occur; equal
    vectors can start several centroids, of which the larger numbers then stay
    as they are. With fewer than ``k`` vectors there are as many centroids as
    vectors; an empty table gives an empty result. Other columns are ignored.
    """
    if not (0 < dimensions <= DIMENSIONS and 0 < k <= MOST_CENTROIDS):
        raise ValueError(f"at most {DIMENSIONS} dimensions and {MOST_CENTROIDS} centroids")
    vectors = stage_table(integer_vectors(df, key, vector, dimensions, scale), "integer-vectors")
    centroids = first_centroids(vectors, k, seed, dimensions)
    for _ in range(rounds):
        for r in _sums(vectors, centroids):
            centroids[r.cluster] = [int(s) // r.n for s in r.s]

    def assign(batches):
        bisectors = Bisectors(centroids)
        for batch in batches:
            for at, x in _blocks(batch, dimensions):
                own = bisectors.nearest(x)
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").slice(at, len(x)), pa.array(own, pa.int32()), pa.array(bisectors.distance(x, own))],
                    ["key", "cluster", "distance"])

    name = vectors.schema["key"].dataType.simpleString()
    assigned = stage_table(vectors.mapInArrow(assign, f"key {name}, cluster int, distance long"), "assigned")
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    table = df.sparkSession.createDataFrame(
        [(c, s, sum(inertia.values())) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long")
    # one row per centroid, at most MOST_CENTROIDS
    return assigned.join(F.broadcast(table), "cluster").select(
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia"), centroids
