"""Reproducible samples and splits.

Random choices are taken in the order of an MD5 of the key and a seed. A
sample of exact size needs the hash at which to cut. The hashes are written
once; the cut is then found digit by digit from counts per prefix, and only the
last few hashes are looked at, so no task ranks a share of the rows.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hash_order
from ..schema import KEYS
from ..session import stage_table

#: Digits by which a prefix is lengthened at a time: 4,096 counts.
DIGITS = 3
#: Most hashes that are fetched to find the last one.
EDGE = 1_000
HASH_DIGITS = 32
ALL = "g"  # sorts after every hexadecimal hash
NONE = ""


def hash_cutoff(df: DataFrame, key: list[str], quota: int, seed: int, edge: int = EDGE) -> str:
    """The hash up to which rows belong to the first ``quota`` keys; rows of one key share a hash and stay together.

    Each round counts the hashes inside the prefix where the quota runs out by
    their next digits and lengthens the prefix, until it holds at most ``edge`` of them.
    """
    if quota <= 0:
        return NONE
    hashed = stage_table(df.select(hash_order(seed, *key).alias("h")), "hashes")
    prefix, left = "", quota
    while True:
        inside = hashed.filter(F.col("h").startswith(prefix))
        size = len(prefix) + DIGITS
        found = {r["p"]: r["c"] for r in inside.groupBy(F.substring("h", 1, size).alias("p")).agg(F.count("*").alias("c")).collect()}
        for p in sorted(found):
            if left <= found[p]:
                break
            left -= found[p]
        else:
            return ALL
        if size >= HASH_DIGITS:
            return p
        prefix = p
        if found[p] <= edge:
            return sorted(r["h"] for r in hashed.filter(F.col("h").startswith(prefix)).collect())[left - 1]


def sample_stations(stations: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` stations (all, if there are fewer)."""
    ids = stations.select("station_id").distinct()
    return stations.filter(hash_order(seed, "station_id") <= hash_cutoff(ids, ["station_id"], n, seed))


def sample_fraction(df: DataFrame, frac: float, seed: int = 42, keep: Column | None = None,
                    key: list[str] = KEYS) -> DataFrame:
    """About ``frac`` of the rows by hash; rows that meet ``keep`` always stay."""
    bound = f"{int(frac * 16 ** 8):08x}" if frac < 1 else ALL
    drawn = F.substring(hash_order(seed, *key), 1, 8) < bound
    return df.filter(drawn if keep is None else drawn | keep)


def balanced_sample(df: DataFrame, label: str, seed: int = 42, key: list[str] = KEYS) -> DataFrame:
    """All rows labelled 1 and as many of those labelled 0."""
    positives = df.filter(F.col(label) == 1).count()
    negatives = df.filter(F.col(label) == 0)
    cutoff = hash_cutoff(negatives, key, positives, seed)
    return df.filter((F.col(label) == 1) | ((F.col(label) == 0) & (hash_order(seed, *key) <= cutoff)))


def shuffle_rows(df: DataFrame, seed: int = 42, key: list[str] = KEYS) -> DataFrame:
    """Random but reproducible order, by a range-partitioned sort."""
    return df.orderBy(hash_order(seed, *key))


def split_by_year_station(df: DataFrame, train_years: list[int], val_years: list[int], station_share: float = 0.1,
                          seed: int = 42) -> DataFrame:
    """``test``: other years. ``val``: validation years or a share of the stations. ``train``: the rest."""
    year = F.year("day")
    known = year.isin([*train_years, *val_years])
    ids = df.filter(known).select("station_id").distinct()
    quota = round(ids.count() * station_share)
    drawn = hash_order(seed, "station_id") <= hash_cutoff(ids, ["station_id"], quota, seed)
    part = F.when(~known, "test").when(year.isin(val_years) | drawn, "val").otherwise("train")
    return df.withColumn("split", part)


def split_test_stations(df: DataFrame, test_years: list[int], seed: int = 42) -> DataFrame:
    """``test``: a tenth of the stations (rounded up) or the given years. ``train``: the rest."""
    ids = df.select("station_id").distinct()
    n = ids.count()
    quota = n - n * 9 // 10
    drawn = hash_order(seed, "station_id") <= hash_cutoff(ids, ["station_id"], quota, seed)
    return df.withColumn("split", F.when(drawn | F.year("day").isin(test_years), "test").otherwise("train"))


def presence_matrix(grid: DataFrame, col: str) -> DataFrame:
    """0/1 per station and day of a dense grid."""
    return grid.select(*KEYS, F.col(col).isNotNull().cast("int").alias("present"))


def split_grid(grid: DataFrame) -> DataFrame:
    """0 absent, 1 train, 2 val, 3 test per station and day of a dense grid with a ``split`` column."""
    code = F.when(F.col("split") == "train", 1).when(F.col("split") == "val", 2).when(F.col("split") == "test", 3)
    return grid.select(*KEYS, F.coalesce(code, F.lit(0)).alias("part"))
