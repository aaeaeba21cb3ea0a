"""Filters, cleaning, deduplication and reshaping of measurements."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import flag
from ..schema import KEYS, LOWEST_PRIORITY, MISSING_RAW, RAIN_EDGES, RAIN_NAMES, raw


def filter_params(df: DataFrame, params: list[str]) -> DataFrame:
    return df.filter(F.col("param").isin(params))


def exclude_param(df: DataFrame, param: str) -> DataFrame:
    return df.filter(F.col("param") != param)


def filter_period(df: DataFrame, first_year: int, years: int = 3) -> DataFrame:
    """Rows of ``years`` calendar years, as a range on the day so that files and row groups are skipped."""
    return df.filter((F.col("day") >= F.make_date(F.lit(first_year), F.lit(1), F.lit(1)))
                     & (F.col("day") < F.make_date(F.lit(first_year + years), F.lit(1), F.lit(1))))


def filter_station(df: DataFrame, station: int, year: int | None = None) -> DataFrame:
    one = df.filter(F.col("station_id") == station)
    return one if year is None else filter_period(one, year, 1)


def project_columns(df: DataFrame, keep: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Keep columns, then rename; a rename may swap two names."""
    rename = rename or {}
    return df.select(*[F.col(c).alias(rename.get(c, c)) for c in keep])


def swap_raw_and_validated(df: DataFrame, params: list[str]) -> DataFrame:
    """Raw values take the validated names, validated values get ``_corrige``: scoring code stays the same."""
    rename = {p: f"{p}_corrige" for p in params} | {raw(p): p for p in params}
    return project_columns(df, df.columns, rename)


def drop_incomplete_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=cols)


def filter_extremes(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows with every column strictly inside its open range; None leaves a side open."""
    tests = [F.col(c) > lo for c, (lo, _) in bounds.items() if lo is not None]
    tests += [F.col(c) < hi for c, (_, hi) in bounds.items() if hi is not None]
    return df.filter(reduce(lambda a, b: a & b, tests))


def stations_active_on(stations: DataFrame, day: str) -> DataFrame:
    """Stations whose first and last day enclose ``day``."""
    return stations.filter(F.lit(day).cast("date").between(F.col("first_day"), F.col("last_day")))


def stations_open(stations: DataFrame, col: str = "in_service", value: str = "O") -> DataFrame:
    return stations.filter(F.col(col) == value)


def fill_raw_from_validated(df: DataFrame) -> DataFrame:
    """An empty raw value means it was never corrected."""
    return df.withColumn("raw_value", F.coalesce("raw_value", "value"))


def null_sentinel(df: DataFrame, value: float = MISSING_RAW) -> DataFrame:
    """Sentinel to NULL; runs after the fill, so a lost raw value stays unknown."""
    return df.withColumn("raw_value", F.nullif(F.col("raw_value"), F.lit(float(value))))


def fill_mode_priority(df: DataFrame, default: int = LOWEST_PRIORITY) -> DataFrame:
    return df.withColumn("mode", F.coalesce("mode", F.lit(default)))


def derive_department(df: DataFrame, col: str = "station_id") -> DataFrame:
    return df.withColumn("department", F.floor(F.col(col) / 100).cast("long"))


def binarise_anomaly(df: DataFrame, min_params: int = 1, col: str = "anomaly", signed: bool = False) -> DataFrame:
    """Count of flagged parameters to 0/1, or to 1/-1 with -1 for an anomaly when ``signed``."""
    hit = F.col(col) >= min_params
    return df.withColumn(col, F.when(hit, -1).otherwise(1) if signed else flag(hit))


def rain_classes(df: DataFrame, col: str, edges: list[float] = RAIN_EDGES,
                 names: list[str] = RAIN_NAMES) -> DataFrame:
    """Named class of each amount (bins closed on the right) and a 0/1 rain flag."""
    inside = [(F.col(col) > lo) & (F.col(col) <= hi) for lo, hi in zip(edges, edges[1:])]
    label = reduce(lambda acc, it: acc.when(it[0], it[1]), zip(inside, names), F)
    return df.withColumns({f"{col}_class": label, f"{col}_present": flag(F.col(col) > 0)})


def dedup_by_priority(df: DataFrame, keys: list[str] = ("station_id", "param", "day"),
                      order: list[str] = ("mode", "row_id")) -> DataFrame:
    """One row per key, smallest ``order`` first.

    A minimum over a struct is combined before the shuffle, so a key with a
    third of all rows sends one row per map task instead of all of them.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def distinct_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def pivot_long_to_wide(df: DataFrame, params: list[str]) -> DataFrame:
    """One row per station and day with a validated and a raw column per parameter.

    The parameter list is fixed, so no extra job looks for distinct values,
    and one hash aggregate combines rows before the only shuffle.
    """
    def cell(p: str, source: str) -> Column:
        return F.max(F.when(F.col("param") == p, F.col(source)))

    return df.filter(F.col("param").isin(params)).groupBy(*KEYS).agg(
        *[cell(p, "value").alias(p) for p in params], *[cell(p, "raw_value").alias(raw(p)) for p in params])


def dedup_and_pivot(df: DataFrame, params: list[str], order: list[str] = ("mode", "row_id")) -> DataFrame:
    """Deduplication by priority and pivot in one shuffle.

    Both group by station and day, so the best row of each parameter is picked
    by conditional minima of the same aggregate.
    """
    def best(p: str) -> Column:
        return F.min(F.when(F.col("param") == p, F.struct(*order, "value", "raw_value")))

    picked = df.filter(F.col("param").isin(params)).groupBy(*KEYS).agg(*[best(p).alias(p) for p in params])
    return picked.select(*KEYS, *[F.col(p).getField("value").alias(p) for p in params],
                         *[F.col(p).getField("raw_value").alias(raw(p)) for p in params])


def unpivot_wide_to_long(df: DataFrame, ids: list[str], cols: list[str], name: str = "param",
                         value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Stack by column name."""
    return reduce(DataFrame.unionByName, dfs)


def attach_columns(df: DataFrame, other: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Side by side columns, matched by key since rows have no position here."""
    return df.join(other, list(keys), "left")


def semi_anti_membership(df: DataFrame, ids: DataFrame, keep: bool = True, on: str = "station_id") -> DataFrame:
    return df.join(ids.select(on).distinct(), on, "left_semi" if keep else "left_anti")


def drop_gappy_stations(df: DataFrame, params: list[str]) -> DataFrame:
    """Remove every station with any missing validated value."""
    gap = reduce(lambda a, b: a | b, [F.col(p).isNull() for p in params])
    return semi_anti_membership(df, df.filter(gap), keep=False)
