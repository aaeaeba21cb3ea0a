"""Density noise: points with too few neighbours that are also near no dense point.

Equal points are folded into one weighted point. The space is cut into a tree
of cells whose leaves hold about equal numbers of points: each cell in two
across the dimension in which it is widest, as a sample shows, and where leaves
are too many for that, on along the leading principal axes. Cells are kept as tables: their
bounding boxes in all dimensions and the weight inside. Every leaf walks down the tree of cells: one
that is within reach as a whole adds its weight without a look at its points,
one out of reach is left, and a point still short of neighbours is sent to the leaves
in doubt whose boxes it reaches itself. There it meets small blocks by the same rule, and stops
looking once it has enough neighbours at every distance. Distances come from products of
matrices, and those too close to a limit for that again by the plain formula.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.evaluate import confusion_counts, metrics_from_counts, select_best_candidate
from ..operators.scale import standardise
from ..session import stage_table
from ..sources.writers import append_run_log

LEAF_POINTS = 8_192
BLOCK = 128
AXES = 3
SLACK = 1e-9
#: Distances from products closer than this to a limit, as a share of the squares that went in, are taken again.
CLOSE = 1e-12
#: Visiting points are compared so many at a time; each looks into so many blocks of its own choice, nearest first.
VISITORS = 4_096
NEAREST = 2
#: A point short of neighbours looks into so many of the nearest other leaves before it is sent to the rest.
NEAREST_LEAVES = 6
#: Sampled points per leaf that show where to cut, and the levels into which the cuts are gathered.
SAMPLE_PER_LEAF = 64
SAMPLED_LEVELS = 3
#: Cells of a level whose cuts or boxes are sent to all tasks; more of them meet the rows by a salted join.
SENT_CELLS = 2_000
SALTS = 32


def _axes(points: DataFrame, width: int) -> np.ndarray:
    """Up to ``AXES`` directions of largest variance as columns, from sums of products: one short table per task."""

    def products(batches):
        gram = np.zeros((width + 1, width + 1))
        for batch in batches:
            if len(batch):
                x = np.column_stack([np.stack(batch["x"].to_numpy()), np.ones(len(batch))])
                gram += x.T @ x
        yield pd.DataFrame({"k": np.arange(gram.size), "v": gram.ravel()})

    sums = points.select("x").mapInPandas(products, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    gram = np.zeros((width + 1) ** 2)
    for r in sums:
        gram[r["k"]] = r["v"]
    gram = gram.reshape(width + 1, width + 1) / max(1.0, gram[-1])
    cov = gram[:-1, :-1] - np.outer(gram[-1, :-1], gram[-1, :-1])
    return np.linalg.eigh(cov)[1][:, ::-1][:, :min(AXES, width)]


def _cuts(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Dimension (-1 at a leaf), cut and first child of the nodes of a tree whose leaves hold at most ``most`` of the points; and their paths."""
    dim, cut, child, path, held = [-1], [0.0], [0], [""], [np.arange(len(x))]
    for node, rows in enumerate(held):  # grows while it is read
        if len(rows) <= most:
            continue
        own = x[rows]
        k = int(np.argmax(own.var(axis=0)))
        values = own[:, k]
        middle = np.median(values)
        if not middle < values.max():  # the larger half is one value
            middle = values[values < middle].max(initial=-np.inf)
        left = values <= middle
        if not left.any() or left.all():
            continue
        dim[node], cut[node], child[node] = k, float(middle), len(held)
        for side, part in (("0", left), ("1", ~left)):
            dim.append(-1), cut.append(0.0), child.append(0), path.append(path[node] + side), held.append(rows[part])
    return np.array(dim), np.array(cut), np.array(child), path


def _sampled_cells(points: DataFrame, n: int, leaf_points: int, sent_cells: int) -> tuple[DataFrame, int, int]:
    """Points with the ``cell`` of a tree cut as a sample shows, the depth of its paths and the number of its leaves."""
    leaves = min(-(-n // leaf_points), sent_cells)
    if leaves < 2:
        return points.withColumn("cell", F.lit("")), 0, 1
    share = min(1.0, SAMPLE_PER_LEAF * leaves / n)
    picked = points.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int(share * (1 << 20)))
    x = _matrix(picked.select("x").toArrow().column("x").combine_chunks())
    dim, cut, child, path = _cuts(x, max(1, len(x) // leaves))
    if len(dim) == 1:
        return points.withColumn("cell", F.lit("")), 0, 1
    # paths of one depth: as many steps to a level as it takes
    each = -(-max(map(len, path)) // SAMPLED_LEVELS)
    names = pa.array(["/".join(p[i * each:(i + 1) * each] or "-" for i in range(SAMPLED_LEVELS)) for p in path])

    def place(batches):
        for batch in batches:
            x, at = _matrix(batch.column("x")), np.zeros(len(batch), np.int64)
            active = np.arange(len(batch))
            while len(active):
                here = at[active]
                inner = dim[here] >= 0
                active, here = active[inner], here[inner]
                at[active] = child[here] + ~(x[active, dim[here]] <= cut[here])
            yield batch.append_column("cell", names.take(pa.array(at)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    rows = stage_table(points.mapInArrow(place, f"{kinds}, cell string"), "density-cells")
    return rows, SAMPLED_LEVELS, int((dim < 0).sum())


def _with_cells(points: DataFrame, axes: np.ndarray, leaf_points: int, sent_cells: int) -> tuple[DataFrame, int]:
    """Points with ``cell``, the path of their leaf in the tree of cells, and the tree's depth.

    Up to ``sent_cells`` leaves come from a sample. Where more are needed, each level
    cuts its cells at quantiles of the next axis, so leaves hold about
    equally many points; how exact the cuts are is no matter to the result.
    These cuts are a table, which the points meet by the path of their cell.
    """
    n = points.count()
    rows, depth, cells = _sampled_cells(points, n, leaf_points, sent_cells)
    parts = max(1, -(-n // leaf_points) // cells if cells > 1 else -(-n // leaf_points))
    per_axis = max(1, round(parts ** (1 / axes.shape[1])))
    fractions = [(i + 1) / per_axis for i in range(per_axis - 1)]
    if not fractions:
        return rows, depth
    salt = F.pmod("id", F.lit(SALTS)).cast("int").alias("salt")
    for level, axis in enumerate(axes.T):
        at = sum((F.element_at("x", i + 1) * float(v) for i, v in enumerate(axis)), F.lit(0.0))
        cuts = rows.groupBy("cell").agg(F.array_sort(F.array_distinct(F.percentile_approx(at, fractions, 1_000))).alias("cuts"))
        cuts = stage_table(cuts, "density-cuts")
        if cells * per_axis ** level <= sent_cells:
            met = rows.join(F.broadcast(cuts), "cell")
        else:
            copies = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = rows.withColumn("salt", salt).join(copies, ["cell", "salt"])
        below = F.size(F.filter("cuts", lambda c: c < at))  # noqa: B023
        rows = stage_table(met.select(F.concat_ws("/", F.nullif("cell", F.lit("")), below.cast("string")).alias("cell"), *points.columns),
                           "density-cells")
    return rows, depth + axes.shape[1]


def _boxes(rows: DataFrame, width: int, depth: int, value: list, largest: bool) -> list[DataFrame]:
    """Per level the cells with ``parent``, ``low`` and ``high`` corners and ``value`` (one number per distance); leaves last."""
    x = [F.element_at("x", i + 1) for i in range(width)]
    corners = [F.array(*[F.min(v) for v in x]).alias("low"), F.array(*[F.max(v) for v in x]).alias("high")]
    cells = stage_table(rows.groupBy("cell").agg(*corners, F.array(*value).alias("value")), "density-boxes")
    levels = [cells]
    for _ in range(depth - 1):
        up = levels[0].withColumn("cell", F.expr("substring_index(cell, '/', size(split(cell, '/')) - 1)"))
        fold = lambda c, f: F.array(*[f(F.element_at(c, i + 1)) for i in range(width)]).alias(c)
        combine = F.max if largest else F.sum
        levels.insert(0, stage_table(up.groupBy("cell").agg(fold("low", F.min), fold("high", F.max), F.array(
            *[combine(F.element_at("value", i + 1)) for i in range(len(value))]).alias("value")), "density-boxes"))
    parent = F.when(F.col("cell").contains("/"), F.expr("substring_index(cell, '/', size(split(cell, '/')) - 1)")).otherwise(F.lit(""))
    return [level.withColumn("parent", parent) for level in levels]


def _within_and_beyond(low_a, high_a, low_b, high_b, eps2):
    """(pairs, distances) of flags: all of one box within reach of all of the other; nothing of it within reach."""
    gap = np.maximum(0, np.maximum(low_b - high_a, low_a - high_b))
    span = np.maximum(high_b - low_a, high_a - low_b)
    # corners meet after other roundings than points, so what is close to a limit stays in doubt
    near, far = (gap * gap).sum(axis=-1)[..., None], (span * span).sum(axis=-1)[..., None]
    return far <= eps2 * (1 - SLACK), near > eps2 * (1 + SLACK)


def _walk(levels: list[DataFrame], eps: list[float], enough: int, largest: bool, sent_cells: int) -> tuple[DataFrame, DataFrame]:
    """(a, base): what whole cells give the points of leaf ``a`` at each distance; and (a, cell, low, high): leaves in doubt that ``a`` must see, with their boxes.

    Leaves that have enough from whole cells at every distance see nothing more.
    """
    leaves, eps2 = levels[-1], np.array(eps) ** 2
    here = leaves.select(F.col("cell").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))

    def decide(batches):
        for batch in batches:
            if len(batch):
                corner = lambda c: np.stack(batch[c].to_numpy())  # noqa: E731, B023
                within, beyond = _within_and_beyond(corner("low_a"), corner("high_a"), corner("low"), corner("high"), eps2)
                settled = (within | beyond).all(axis=1)
                given = np.where(within, np.stack(batch["value"].to_numpy()), 0)
                keep = ~settled | within.any(axis=1)
                yield pd.DataFrame({"a": batch["a"], "cell": batch["cell"], "settled": settled, "given": list(given)})[keep]

    gather = F.max if largest else F.sum
    add = lambda df: df.groupBy("a").agg(F.array(*[gather(F.element_at("given", i + 1)) for i in range(len(eps))]).alias("base"))
    base, doubt = None, here.select("a", F.lit("").alias("cell"))
    for k, level in enumerate(levels):
        salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")
        if k == 0 or level.count() <= sent_cells:
            pairs = doubt.withColumnRenamed("cell", "parent").join(F.broadcast(level), "parent")
        else:
            copies = level.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            pairs = doubt.withColumnRenamed("cell", "parent").withColumn("salt", salt).join(copies, ["parent", "salt"])
        decided = stage_table(pairs.join(here, "a").select("a", "low_a", "high_a", "cell", "low", "high", "value").mapInPandas(
            decide, "a string, cell string, settled boolean, given array<long>"), "density-pairs")
        settled = decided.filter("settled").select("a", "given")
        base = add(settled if base is None else settled.unionByName(base.withColumnRenamed("base", "given")))
        base = stage_table(base, "density-base")
        full = base.filter(F.forall("base", lambda v: v >= enough)).select("a")
        doubt = decided.filter(~F.col("settled")).select("a", "cell").join(full, "a", "left_anti")
    return base, doubt.join(leaves.select("cell", "low", "high"), "cell")


def _visits(rows: DataFrame, base: DataFrame, doubt: DataFrame, extra: list[str]) -> DataFrame:
    """Every leaf's own points with its base."""
    itself = doubt.filter("a = cell").select("a", F.lit(False).alias("settled"))
    own = rows.withColumnRenamed("cell", "a").join(base, "a", "left").join(itself, "a", "left").select(
        F.col("a").alias("leaf"), "id", "w", "x", *extra, "base", F.coalesce("settled", F.lit(True)).alias("settled"))
    return own.repartition("leaf").sortWithinPartitions("leaf")


def _guests(rows: DataFrame, found: DataFrame, doubt: DataFrame, enough: int, value: str, name: str,
            eps: list[float] = (), places: tuple[int, int | None] = (0, None)) -> DataFrame:
    """The points of every leaf, then those of other leaves that are short of ``enough`` after their own and must see it.

    With ``eps`` a point sees only the leaves whose boxes are within a distance at which it is short, and of
    all leaves in doubt only those that come at such places in the order of their distance.
    """
    short = rows.join(found.filter(F.exists(name, lambda v: v < enough)), "id").withColumnRenamed("cell", "a")
    hosts = rows.select(F.col("cell").alias("leaf"), F.lit(False).alias("visitor"), "id", "x", value, F.lit(None).cast("array<long>").alias("start"))
    seen = doubt.filter("a <> cell")
    met = _reached(short, seen, eps, enough, name, places) if eps else short.join(seen, "a").select(
        F.col("cell").alias("leaf"), "id", "x", F.col(name).alias("start"))
    guests = met.select("leaf", F.lit(True).alias("visitor"), "id", "x", F.lit(None).cast(rows.schema[value].dataType).alias(value), "start")
    return hosts.unionByName(guests).repartition("leaf").sortWithinPartitions("leaf", "visitor")


def _reached(short: DataFrame, doubt: DataFrame, eps: list[float], enough: int, name: str, places: tuple[int, int | None]) -> DataFrame:
    """The points of each leaf ``a`` once per leaf whose box they reach: the boxes come first, points pass in batches."""
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    boxes = doubt.select("a", F.lit(False).alias("point"), "cell", "low", "high", *[none(short, c) for c in ("id", "x", name)])
    points = short.select("a", F.lit(True).alias("point"), *[none(doubt, c) for c in ("cell", "low", "high")], "id", "x", name)
    limits = np.array(eps) ** 2 * (1 + SLACK)

    def run(batches):
        at, cells, waiting = None, None, []
        for (key, point), rows in _runs(batches, "a", "point"):
            if key != at:
                at, cells, waiting = key, None, []
            if not point:
                waiting.append(rows)
                continue
            if cells is None and waiting:
                own = pa.Table.from_batches(waiting).sort_by("cell")  # so that equal distances always come in one order
                cells, low, high = (own.column(c).combine_chunks() for c in ("cell", "low", "high"))
                low, high, waiting = _matrix(low), _matrix(high), []
            if cells is None:  # no leaf in doubt
                continue
            step = max(1, VISITORS * BLOCK // len(cells))
            for part in (rows.slice(i, step) for i in range(0, len(rows), step)):
                x, start = _matrix(part.column("x")), _matrix(part.column(name))
                near = np.zeros((len(x), len(low)))
                for d in range(x.shape[1]):
                    gap = np.maximum(0, np.maximum(low[:, d] - x[:, d, None], x[:, d, None] - high[:, d]))
                    near += gap * gap
                able = near <= np.where(start < enough, limits, -1.0).max(axis=1)[:, None]
                if places != (0, None):
                    chosen = np.zeros(near.shape, bool)
                    np.put_along_axis(chosen, near.argsort(axis=1, kind="stable")[:, places[0]:places[1]], True, axis=1)
                    able &= chosen
                i, j = map(pa.array, np.nonzero(able))
                yield pa.record_batch([cells.take(j), *(part.column(c).take(i) for c in ("id", "x", name))], names=["leaf", "id", "x", "start"])

    met = boxes.unionByName(points).repartition("a").sortWithinPartitions("a", "point")
    return met.mapInArrow(run, "leaf string, id long, x array<double>, start array<long>")


def _matrix(lists) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _lists(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    return pa.ListArray.from_arrays(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1], np.ascontiguousarray(matrix).ravel())


def _runs(batches, *keys: str):
    """(values of ``keys``, rows) of neighbouring rows that agree in them."""
    for batch in batches:
        if not len(batch):
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        ends = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1
        for i, j in zip([0, *ends], [*ends, len(batch)]):
            yield tuple(v[i] for v in values), batch.slice(i, j - i)


class _Hosts:
    """Points of a leaf in blocks that lie together; others look among them for neighbours."""

    def __init__(self, x: np.ndarray, value: np.ndarray, eps: list[float], enough: int, largest: bool):
        self.eps2, self.enough, self.largest = np.array(eps) ** 2, enough, largest
        self.order, self.ends = self._together(x)
        self.x, self.value = x[self.order], value[self.order]
        with np.errstate(invalid="ignore"):
            centre = self.x.mean(axis=0)
        self.centre = np.where(np.isfinite(centre), centre, 0.0)
        self.moved, self.squares = self._moved(self.x)
        starts = np.r_[0, self.ends[:-1]]
        self.blocks = list(zip(starts, self.ends))
        self.low, self.high = np.minimum.reduceat(self.x, starts), np.maximum.reduceat(self.x, starts)
        self.whole = (np.maximum if largest else np.add).reduceat(self.value, starts)
        self.ones = not largest and bool((self.value == 1).all())

    @staticmethod
    def _together(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of points and the ends of its blocks: halves across the widest dimension, again and again."""
        todo, order, ends, n = [np.arange(len(x))], [], [], 0
        while todo:
            rows = todo.pop()
            if len(rows) > BLOCK:
                own = x[rows]
                across = own[:, np.argmax(own.max(axis=0) - own.min(axis=0))]
                half = len(rows) // 2
                parted = rows[np.argpartition(across, half)]
                todo += [parted[half:], parted[:half]]
                continue
            order.append(rows)
            n += len(rows)
            ends.append(n)
        return np.concatenate(order), np.array(ends)

    def _moved(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        moved = x - self.centre
        return moved, np.einsum("ij,ij->i", moved, moved)

    def at_home(self, found: np.ndarray) -> np.ndarray:
        """What the hosts have found, in their own order given and returned, after a look among themselves."""
        own = found[self.order]
        for k, (i, j) in enumerate(self.blocks):
            rows = i + np.flatnonzero((own[i:j] < self.enough).any(axis=1))
            if len(rows):
                self._compare(self.x, self.moved, self.squares, own, rows, k)
        short = np.flatnonzero((own < self.enough).any(axis=1))
        if len(short):
            rest = own[short]
            self.look(self.x[short], rest, np.searchsorted(self.ends, short, side="right"))
            own[short] = rest
        out = np.empty_like(own)
        out[self.order] = own
        return out

    def look(self, x: np.ndarray, found: np.ndarray, seen: np.ndarray | None = None) -> None:
        """Adds to ``found`` what points find here, but for the block each has seen already."""
        for i in range(0, len(x), VISITORS):
            part = slice(i, i + VISITORS)
            self._look(x[part], found[part], None if seen is None else seen[part])

    def _look(self, x, found, seen):
        near, far = np.zeros((2, len(x), len(self.blocks)))
        for d in range(x.shape[1]):
            above, below = self.low[:, d] - x[:, d, None], x[:, d, None] - self.high[:, d]
            gap = np.maximum(0, np.maximum(above, below))
            near += gap * gap
            # what lies behind a block's far side is its extent beyond the near one
            span = np.maximum(np.abs(above), np.abs(below))
            far += span * span
        within = [far <= limit * (1 - SLACK) for limit in self.eps2]
        beyond = [near > limit * (1 + SLACK) for limit in self.eps2]
        open_ = ~np.logical_and.reduce([w | b for w, b in zip(within, beyond)])
        if seen is not None:
            open_[np.arange(len(x)), seen] = False
        for e, w in enumerate(within):
            given = w & ~open_
            if seen is not None:
                given[np.arange(len(x)), seen] = False
            if self.largest:
                found[:, e] = np.maximum(found[:, e], np.where(given, self.whole[:, e], 0).max(axis=1))
            elif given.any():
                found[:, e] += given @ self.whole[:, min(e, self.whole.shape[1] - 1)]
        moved, squares = self._moved(x)
        reach = [near <= limit * (1 + SLACK) for limit in self.eps2]
        wanted = lambda rows: np.logical_or.reduce([
            reach[e][rows] & (found[rows, e] < self.enough)[:, None] for e in range(len(self.eps2))])
        for _ in range(min(NEAREST, len(self.blocks))):
            rows = np.flatnonzero((found < self.enough).any(axis=1))
            if not len(rows):
                return
            able = open_[rows] & wanted(rows)
            first = np.where(able, near[rows], np.inf).argmin(axis=1)
            rows, first = rows[able[np.arange(len(rows)), first]], first[able[np.arange(len(rows)), first]]
            order = np.argsort(first, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
                if len(part):
                    self._compare(x, moved, squares, found, rows[part], first[part[0]])
            open_[rows, first] = False
        for k in range(len(self.blocks)):
            short = found < self.enough
            rows = np.flatnonzero(open_[:, k] & np.logical_or.reduce([reach[e][:, k] & short[:, e] for e in range(len(self.eps2))]))
            if len(rows):
                self._compare(x, moved, squares, found, rows, k)

    def _compare(self, x, moved, squares, found, rows, k):
        i, j = self.blocks[k]
        d2 = squares[rows, None] + self.squares[i:j] - 2 * (moved[rows] @ self.moved[i:j].T)
        size = squares[rows].max() + self.squares[i:j].max()
        for e, limit in enumerate(self.eps2):
            near = d2 <= limit
            close = np.abs(d2 - limit) <= CLOSE * (size + limit)
            if close.any():
                a, b = np.nonzero(close)
                d = x[rows[a]] - self.x[i + b]
                exact = d[:, 0] * d[:, 0]
                for c in range(1, d.shape[1]):  # in this order the sums are those of the plain formula
                    exact = exact + d[:, c] * d[:, c]
                near[a, b] = exact <= limit
            if self.largest:
                best = np.where(near, self.value[None, i:j, e], 0).max(axis=1)
                found[rows, e] = np.maximum(found[rows, e], best)
            else:
                found[rows, e] += np.count_nonzero(near, axis=1) if self.ones else near @ self.value[i:j, 0]


def _values(rows: pa.Table, column: str, largest: bool) -> np.ndarray:
    held = rows.column(column).combine_chunks()
    return _matrix(held) if largest else held.to_numpy(zero_copy_only=False).reshape(-1, 1).astype(np.int64)


def _search(visits: DataFrame, eps: list[float], enough: int, given: str | None, name: str) -> DataFrame:
    """What points find among those of their own leaf."""

    def start(own):
        own = pa.Table.from_batches(own)
        x, value = _matrix(own.column("x").combine_chunks()), _values(own, given or "w", given is not None)
        base = own.column("base")[0].as_py()
        base = np.zeros(len(eps), np.int64) if base is None else np.asarray(base)
        found = np.maximum(value, base) if given else np.zeros((len(own), len(eps)), np.int64) + base
        if not own.column("settled")[0].as_py():  # else its own box has given all that is to give
            found = _Hosts(x, value, eps, enough, given is not None).at_home(found)
        return pa.record_batch([own.column("id").combine_chunks(), _lists(np.minimum(found, enough))], names=["id", name])

    def run(batches):
        at, waiting = None, []
        for key, rows in _runs(batches, "leaf"):
            if key != at and waiting:  # all own points are there
                yield start(waiting)
                waiting = []
            at = key
            waiting.append(rows)
        if waiting:
            yield start(waiting)

    return visits.mapInArrow(run, f"id long, {name} array<long>")


def _search_abroad(visits: DataFrame, eps: list[float], enough: int, value: str, largest: bool, name: str) -> DataFrame:
    """What guests find in the leaves they see, besides what they came with."""

    def run(batches):
        at, hosts, waiting = None, None, []
        for (key, visitor), rows in _runs(batches, "leaf", "visitor"):
            if key != at:
                at, hosts, waiting = key, None, []
            if not visitor:
                waiting.append(rows)
                continue
            if hosts is None:
                own = pa.Table.from_batches(waiting)
                hosts, waiting = _Hosts(_matrix(own.column("x").combine_chunks()), _values(own, value, largest), eps, enough, largest), []
            start = _matrix(rows.column("start"))
            found = start.copy()
            hosts.look(_matrix(rows.column("x")), found)
            more = np.minimum(found, enough) - (0 if largest else np.minimum(start, enough))
            yield pa.record_batch([rows.column("id"), _lists(more)], names=["id", name])

    return visits.mapInArrow(run, f"id long, {name} array<long>")


def density_reach(df: DataFrame, cols: list[str], eps: list[float] | float, enough: int, leaf_points: int = LEAF_POINTS,
                  sent_cells: int = SENT_CELLS) -> DataFrame:
    """Distinct points of ``cols`` with ``reach``: for each ``eps`` the largest neighbour count among their neighbours.

    A neighbour is at most ``eps`` away and a point is its own neighbour, so a
    point is noise for some ``min_samples <= enough`` exactly if its reach is
    below it. Counts are reported up to ``enough``. Rows with an unknown coordinate are no points.
    """
    eps = [float(e) for e in (eps if isinstance(eps, (list, tuple)) else [eps])]
    x = [f"x{i}" for i in range(len(cols))]
    points = df.na.drop(subset=cols).groupBy(*[F.col(c).cast("double").alias(n) for c, n in zip(cols, x)]).agg(
        F.count("*").alias("w")).select(F.array(*x).alias("x"), "w", F.monotonically_increasing_id().alias("id"))
    points = stage_table(points, "density-points")
    rows, depth = _with_cells(points, _axes(points, len(cols)), leaf_points, sent_cells)

    def searched(rows: DataFrame, value: list, given: str | None, name: str) -> DataFrame:
        levels = _boxes(rows, len(cols), depth, value, given is not None)
        base, doubt = _walk(levels, eps, enough, given is not None, sent_cells)
        home = stage_table(_search(_visits(rows, base, doubt, [given] if given else []), eps, enough, given, name), "density-home")
        if not depth:
            return home
        gather = F.max if given else F.sum
        each = [F.least(gather(F.element_at(name, i + 1)), F.lit(enough).cast("long")) for i in range(len(eps))]

        def after(found: DataFrame, places: tuple[int, int | None]) -> DataFrame:
            guests = _guests(rows, found, doubt, enough, given or "w", name, eps, places)
            abroad = _search_abroad(guests, eps, enough, given or "w", given is not None, name)
            return found.unionByName(abroad).groupBy("id").agg(F.array(*each).alias(name))

        if given:  # few are short by now
            return after(home, (0, None))
        return after(stage_table(after(home, (0, NEAREST_LEAVES)), "density-near"), (NEAREST_LEAVES, None))

    counts = searched(rows, [F.sum("w")] * len(eps), None, "counts")
    counted = stage_table(rows.join(counts, "id"), "density-counts")
    found = searched(counted, [F.max(F.element_at("counts", i + 1)) for i in range(len(eps))], "counts", "reach")
    return counted.join(found, "id").select(*[F.element_at("x", i + 1).alias(c) for i, c in enumerate(cols)], "reach")


def density_noise(df: DataFrame, cols: list[str], eps: float, min_samples: int, name: str = "noise", unknown: int = 1) -> DataFrame:
    """1 for noise, 0 for every clustered point. Rows with an unknown coordinate stay and get ``unknown``."""
    reach = density_reach(df, cols, eps, min_samples)
    noise = (F.col("reach")[0] < min_samples).cast("int")
    return df.join(reach, list(cols), "left").withColumn(name, F.coalesce(noise, F.lit(unknown))).drop("reach")


def density_noise_grid(df: DataFrame, cols: list[str], real: str, eps_list: list[float],
                       min_samples_list: list[int], unknown: int = 1) -> DataFrame:
    """Confusion counts and metrics per candidate; one search serves all of them."""
    reach = density_reach(df, cols, list(eps_list), max(min_samples_list))
    scored = df.select(real, *cols).join(reach, list(cols), "left")
    cases = [(i, float(e), m) for i, e in enumerate(eps_list) for m in min_samples_list]
    sums, cells = [], []
    for i, e, m in cases:
        noise = F.coalesce((F.col("reach")[i] < m).cast("int"), F.lit(unknown))
        sums += [s.alias(f"{n}_{i}_{m}") for s, n in zip(confusion_counts(F.col(real), noise), ("TP", "TN", "FP", "FN"))]
        cells.append(F.struct(F.lit(e).alias("eps"), F.lit(m).alias("min_samples"),
                              *[F.col(f"{n}_{i}_{m}").alias(n) for n in ("TP", "TN", "FP", "FN")]))
    return metrics_from_counts(scored.agg(*sums).select(F.inline(F.array(*cells))))


def detect(df: DataFrame, params: list[str], cols: list[str], eps_list: list[float] = (0.5, 0.45, 0.4),
           min_samples_list: list[int] = (50, 25, 15), log_path: str | None = None) -> DataFrame:
    """Standardise, try all candidates and report the noise of the best one for the row and for every parameter.

    The truth is an anomaly in more than one parameter. Best is the highest
    recall among candidates with an accuracy above 0.7; if there is none,
    nothing is reported. A row with an unknown value is an anomaly. One search
    serves all candidates, whose counts and metrics go to ``log_path``.
    """
    scaled = stage_table(standardise(df.select("station_id", "day", F.col("anomaly").alias("_found"), *cols), cols), "standardised")
    reach = density_reach(scaled, cols, list(eps_list), max(min_samples_list))
    reached = stage_table(scaled.join(reach, list(cols), "left").select(
        "station_id", "day", (F.col("_found") > 1).cast("int").alias("real"), "reach"), "density-reach")
    cases = [(i, float(e), m) for i, e in enumerate(eps_list) for m in min_samples_list]
    noise = lambda i, m: F.coalesce((F.col("reach")[i] < m).cast("int"), F.lit(1))
    report = metrics_from_counts(reached.select("real", F.inline(F.array(*[F.struct(
        F.lit(e).alias("eps"), F.lit(m).alias("min_samples"), noise(i, m).alias("pred")) for i, e, m in cases]))).groupBy(
        "eps", "min_samples").agg(*confusion_counts(F.col("real"), F.col("pred"))))
    if log_path:
        append_run_log(report, log_path)
    best = select_best_candidate(report.filter("recall > 0")).first()
    found = F.lit(0) if best is None else noise([float(e) for e in eps_list].index(best["eps"]), best["min_samples"])
    flagged = df.join(reached.select("station_id", "day", found.alias("anomaly_pred")), ["station_id", "day"]).withColumn("is_test", F.lit(1))
    return flagged.withColumns({f"{p}_anomaly_pred": F.col("anomaly_pred") for p in params})
