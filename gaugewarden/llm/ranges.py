"""Shards of consecutive keys that depend on the rows alone, not on how Spark has split them."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import drop_path, scratch_path


def shard_starts(df: DataFrame, key: str, rows_per_shard: int, max_shards: int) -> np.ndarray:
    """First keys of the shards 1, 2, ... of ``df`` in ascending order of ``key`` (an integer; nulls go to shard 0).

    The keys alone are sorted in ranges and written; counts of the ranges give
    each row its global position, and the key at every ``rows_per_shard``-th
    position starts a shard. There are at most ``max_shards``, which bounds
    what the driver gets: beyond that shards hold more rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "sorted-keys")
    ordered = df.select(F.col(key).cast("long").alias("k")).where("k IS NOT NULL").repartitionByRange("k").sortWithinPartitions("k")
    ordered.withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(path)
    kept = spark.read.schema("k long, part int").parquet(path)
    before, offsets = 0, {}
    for part, n in sorted(kept.groupBy("part").count().collect()):  # one row per range
        offsets[part] = before
        before += n
    step = max(rows_per_shard, -(-before // max_shards))

    def cuts(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            for part, keys in batch.groupby("part", sort=False)["k"]:
                at = offsets[part] + seen.get(part, 0) + np.arange(len(keys))
                seen[part] = seen.get(part, 0) + len(keys)
                yield pd.DataFrame({"k": keys.to_numpy()[(at % step == 0) & (at > 0)]})

    one_task_per_range = kept.repartition("part").sortWithinPartitions("part", "k")
    found = [r.k for r in one_task_per_range.mapInPandas(cuts, "k long").collect()]
    drop_path(spark, path)
    return np.unique(np.array(found, np.int64))


def in_shards(df: DataFrame, key: str, starts: np.ndarray, *then: str) -> DataFrame:
    """``df`` with column ``shard``, every shard whole in one task and sorted by shard, ``key`` and ``then``."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        out = np.zeros(len(keys), np.int32)
        out[known] = np.searchsorted(starts, keys[known].to_numpy(np.int64), side="right")
        return pd.Series(out)

    # ranges, not hashes, of the shard number: hashing would put several shards into one task and none into others
    dealt = df.withColumn("shard", shard(F.col(key).cast("long"))).repartitionByRange(len(starts) + 1, "shard")
    return dealt.sortWithinPartitions("shard", F.col(key).asc_nulls_first(), *then)
