"""Near-duplicate vectors by int8 tile products with error bounds.

Equal vectors of a label are folded into one point first. The points of a
label are dealt to stripes; a stripe holds its own points in memory and lets
the points of half of the other stripes pass in batches, so each pair of
stripes meets once. A tile of own points times a batch is multiplied in int8
codes, whose sums are exact in single precision; a bound on both vectors'
rounding tells which pairs may reach the threshold, and only these are computed
again in double precision. Pairs never leave a task: it returns link counts and
the links of a spanning forest of each tile.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import stage_table
from .components import connected_components

LINKS = "node long, other long, links long"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors in double precision, their int8 codes (as exact floats), scales and error norms."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - code * scale[:, None]) ** 2).sum(axis=1))
    return unit, code.astype(np.float32), scale, error


def possible_pairs(a, b, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose cosine may reach ``threshold``.

    With u = p + e and v = q + f (codes and errors), u.v - p.q = e.q + u.f, so
    the product of the codes is off by at most |e|(1 + |f|) + |f|.
    """
    if a[1].shape[1] <= 1024:
        product = (a[1] @ b[1].T).astype(np.float64)
    else:  # longer sums would leave the range of exact integers in single precision
        product = a[1].astype(np.float64) @ b[1].T.astype(np.float64)
    product *= a[2][:, None] * b[2][None, :]
    bound = a[3][:, None] * (1 + b[3][None, :]) + b[3][None, :] + 1e-9
    return np.nonzero(product + bound >= threshold)


def exact_links(a, b, threshold: float, at_once: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    i, j = possible_pairs(a, b, threshold)
    keep = [np.einsum("ij,ij->i", a[0][i[k:k + at_once]], b[0][j[k:k + at_once]]) >= threshold for k in range(0, len(i), at_once)]
    hit = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[hit], j[hit]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its part) that connect what the links ``a[i]``, ``b[i]`` connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


class _Stripe:
    """Own points of a stripe and what has been found of them so far."""

    def __init__(self, threshold: float, tile: int):
        self.threshold, self.tile, self.tiles = threshold, tile, []

    def found(self, own, ids_a, n_a, other, ids_b, n_b, same: bool):
        i, j = exact_links(own, other, self.threshold)
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            node, root = forest(ids_a[i], ids_b[j])
            yield pd.DataFrame({"node": node, "other": root, "links": 0})
            for ids, count in ((ids_a, np.bincount(i, n_b[j], len(ids_a))), (ids_b, np.bincount(j, n_a[i], len(ids_b)))):
                some = count > 0
                yield pd.DataFrame({"node": ids[some], "other": ids[some], "links": count[some].astype(np.int64)})

    def add(self, ids, copies, x, own: bool):
        for k in range(0, len(ids), self.tile):
            part = (quantised(x[k:k + self.tile]), ids[k:k + self.tile], copies[k:k + self.tile])
            for tile in self.tiles:
                yield from self.found(*tile, *part, False)
            if own:
                yield from self.found(*part, *part, True)
                self.tiles.append(part)


def compare_stripes(points: DataFrame, threshold: float, stripe_rows: int, tile: int = 1024) -> DataFrame:
    """Rows (node, other, links): link counts where node = other, else links of spanning forests."""
    sizes = stage_table(points.groupBy("label", "dim").agg(F.ceil(F.count("*") / stripe_rows).alias("stripes")), "stripes")
    placed = points.join(sizes, ["label", "dim"]).withColumn("stripe", F.pmod(F.xxhash64("embedding"), "stripes"))
    # round the circle of stripes, a host receives those less than half the way ahead; of two that face each other, one hosts
    hosts = F.expr("transform(sequence(0L, CAST(stripes / 2 AS LONG)), d -> pmod(stripe - d, stripes))")
    visits = placed.withColumn("host", F.explode(hosts)).withColumn("away", F.expr("pmod(stripe - host, stripes)")).where(
        "2 * away < stripes OR (2 * away = stripes AND host < away)")
    sorted_visits = visits.select("label", "dim", "host", (F.col("away") > 0).alias("visitor"), "node", "copies", "embedding").repartition(
        "label", "dim", "host").sortWithinPartitions("label", "dim", "host", "visitor")

    def multiply(batches):
        stripe, at = None, None
        for batch in batches:
            for (label, dim, host, visitor), rows in batch.groupby(["label", "dim", "host", "visitor"], sort=True):
                if (label, dim, host) != at:
                    stripe, at = _Stripe(threshold, tile), (label, dim, host)
                x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
                yield from stripe.add(rows["node"].to_numpy(), rows["copies"].to_numpy(), x, not visitor)

    return sorted_visits.mapInPandas(multiply, LINKS)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, stripe_rows: int = 4_096, key: str = "vec_id",
                           vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: ``key``, n_links, component_id, kept (it names its component).

    Only vectors of one label and one length are compared, by cosine in double
    precision. Vectors that are null, empty, zero or hold null or non-finite
    components, vectors without a label and rows without a key link with
    nothing. Repeated rows count as vectors of their own. Other columns are not read.
    """
    x = F.col("embedding")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("embedding"))
    usable = (F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0)
              & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
              & F.exists(x, lambda v: v != 0))
    usable = F.coalesce(usable, F.lit(False))
    classes = rows.where(usable).groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    points = stage_table(classes.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()),
                         "distinct-vectors")
    found = stage_table(compare_stripes(points, threshold, stripe_rows), "vector-links")
    roots = connected_components(found.where("node != other"), "node", "other").select(F.col("node"), "root")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = stage_table(points.join(counts, "node", "left").join(roots, "node", "left").select(
        "label", "embedding", "rep", F.coalesce("root", "node").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "rooted-vectors")
    smallest = stage_table(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "vector-components")
    named = stage_table(rooted.join(smallest, "root").drop("root", "rep"), "vector-classes")
    linked = rows.where(usable).join(named, ["label", "embedding"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id",
                                            F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
