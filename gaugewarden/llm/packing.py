"""Best-fit packing with certified bin counts.

Items are dealt to partitions, and each is packed by best-fit decreasing.
Dual feasible functions bound from below how many bins a partition needs. A
partition that meets its bound is certified; partitions with a gap exchange
their items, all partitions exchange those of loosely filled bins while the
bound of all items is not met, and the exchanged items are packed again.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import drop_path, scratch_path, stage_table

PLACED = "item long, length int, bin long, offset int, fill int, bins long, bound long"
UNIT_FRACTIONS = 24


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Most bins that a dual feasible function proves necessary; ``counts[s]`` items have size ``s`` (up to ``capacity``).

    Tried are the identity, the functions that drop small and round up large
    sizes, for every threshold, and the step functions of k + 1 parts.
    """
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    number, volume = np.cumsum(counts), np.cumsum(counts * size)
    eps = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - eps]  # sizes above capacity - eps take a bin each
    middle = volume[capacity - eps] - np.where(eps > 0, volume[np.maximum(eps - 1, 0)], 0)
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, UNIT_FRACTIONS + 1):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        steps = np.where(whole, k * size, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((counts * steps).sum()) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of every item and the fill of every bin; sizes 1 to ``capacity``.

    Bins wait in one stack per free space; the set bits of an integer tell which stacks hold any.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    waiting = 0
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = waiting >> s
        if fitting:
            free = s + (fitting & -fitting).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                waiting ^= 1 << free
        else:
            free, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += s
        if free > s:
            stacks[free - s].append(b)
            waiting |= 1 << (free - s)
    return bins, offsets, np.array(fills, np.int64)


def _pack_parts(items: DataFrame, capacity: int, parts: int, round_: int) -> DataFrame:
    """``items`` (item, length) dealt by hash to ``parts`` and packed; bins are numbered by round, part and bin."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        sizes = part["length"].to_numpy(np.int64)
        bins, offsets, fills = best_fit(sizes, capacity)
        number = (round_ << 56) + (int(part["part"].iloc[0]) << 28) + bins
        return pd.DataFrame({"item": part["item"], "length": part["length"], "bin": number, "offset": offsets, "fill": fills[bins],
                             "bins": len(fills), "bound": lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)})

    dealt = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(round_)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, PLACED)


def _summary(items: DataFrame, capacity: int) -> tuple[int, int, int]:
    """(items, bins, lower bound) of a table with item, length and bin; one row per length reaches the driver."""
    lengths = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").count().collect():
        lengths[r["length"]] = r["count"]
    bins = items.where("offset = 0").count()
    return int(lengths.sum()), bins, lower_bound(lengths, capacity)


def pack(items: DataFrame, capacity: int, length: str = "length", part_items: int = 20_000, loose: float = 1 / 32,
         max_rounds: int = 6) -> DataFrame:
    """``items`` with sequence_id and offset: as few sequences of at most ``capacity`` as the rounds find.

    Every row is an item of its own, repeated rows too; its ``length`` must lie
    between 1 and ``capacity`` (a null or other one raises). Sequences have no
    gaps. Rounds end when the bound of all items is met, when an exchange saves
    no bin, or after ``max_rounds``; an exchange that would need more bins is discarded.
    """
    spark = items.sparkSession
    rows = stage_table(items.withColumn("item", F.monotonically_increasing_id()), "items")
    sized = rows.select("item", F.col(length).cast("int").alias("length"))
    ok = F.col("length").between(1, capacity)
    sized = sized.withColumn("length", F.when(ok, F.col("length")).otherwise(F.raise_error(F.lit("a length is null or out of range"))))
    count = rows.count()
    path = scratch_path(spark, "packed-0")
    _pack_parts(sized, capacity, max(1, -(-count // part_items)), 0).write.parquet(path)
    placed = spark.read.schema(PLACED).parquet(path)
    _, bins, bound = _summary(placed, capacity)
    for round_ in range(1, max_rounds + 1):
        if bins <= bound:
            break
        exchanged = (F.col("bins") > F.col("bound")) | (F.col("fill") < capacity * (1 - loose))
        moving = placed.where(exchanged)
        n, before, least = _summary(moving, capacity)
        if before <= least:
            break
        trial = scratch_path(spark, f"exchange-{round_}")
        _pack_parts(moving.select("item", "length"), capacity, max(1, -(-n // part_items)), round_).write.parquet(trial)
        repacked = spark.read.schema(PLACED).parquet(trial)
        saved = before - repacked.where("offset = 0").count()
        if saved <= 0:
            drop_path(spark, trial)
            break
        new = scratch_path(spark, f"packed-{round_}")
        placed.where(~exchanged).unionByName(repacked).write.parquet(new)
        placed = spark.read.schema(PLACED).parquet(new)
        drop_path(spark, path)
        drop_path(spark, trial)
        path, bins = new, bins - saved
    where = placed.select("item", F.col("bin").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    return rows.drop("sequence_id", "offset").join(where, "item").drop("item")
