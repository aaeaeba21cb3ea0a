"""Aggregates, profiles and top rows."""

from functools import reduce
from itertools import combinations_with_replacement
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import flag
from ..schema import raw
from .quantiles import exact_quantiles, quantiles_exact

UNITS = {"year": F.year, "month": F.month}


def _period(unit: str) -> Column:
    return UNITS[unit](F.col("day")).alias(unit)


def corrections_by_period_param(df: DataFrame, unit: str) -> DataFrame:
    """Corrections per period and parameter: all, with an unknown raw value, and with a known one, in one pass."""
    unknown = F.col("raw_value").isNull()
    return df.groupBy(_period(unit), "param").agg(
        F.sum("correction").alias("corrections"),
        F.sum(F.when(unknown, F.col("correction"))).alias("corrections_raw_unknown"),
        F.sum(F.when(~unknown, F.col("correction"))).alias("corrections_raw_known"))


def mean_by_period_param(df: DataFrame, unit: str) -> DataFrame:
    return df.groupBy(_period(unit), "param").agg(F.avg("value").alias("mean_value"))


def relative_correction(df: DataFrame, unit: str) -> DataFrame:
    """Mean signed correction over mean raw value, over corrected rows."""
    means = df.filter(F.col("correction") == 1).groupBy(_period(unit), "param").agg(
        F.avg("difference").alias("mean_difference"), F.avg("raw_value").alias("mean_raw"))
    return means.withColumn("relative_corr", F.try_divide("mean_difference", "mean_raw"))


def distinct_years_per_station(df: DataFrame) -> DataFrame:
    return df.groupBy("station_id").agg(F.count_distinct(F.year("day")).alias("years"))


def stations_per_year(df: DataFrame, approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.groupBy(F.year("day").alias("year")).agg(count("station_id").alias("stations"))


def station_validity(df: DataFrame) -> DataFrame:
    return df.groupBy("station_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def daily_anomaly_rate(df: DataFrame) -> DataFrame:
    daily = df.groupBy("day").agg(F.sum("anomaly").alias("anomalies"), F.count("anomaly").alias("rows"))
    return daily.withColumn("rate", F.col("anomalies") / F.col("rows"))


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null count per column as one row per column, from one pass."""
    cols = cols or df.columns
    one = df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "nulls")


def conditional_share(df: DataFrame, condition: Column, within: Column | None = None) -> DataFrame:
    """Share of the rows of ``within`` that meet ``condition``; unknown counts as not met."""
    rows = df if within is None else df.filter(within)
    return rows.agg(F.count("*").alias("rows"), F.avg(flag(condition)).alias("share"))


def value_counts(df: DataFrame, col: str, normalise: bool = False) -> DataFrame:
    counts = df.groupBy(col).agg(F.count("*").alias("count"))
    if not normalise:
        return counts
    total = df.agg(F.count("*")).scalar()
    return counts.withColumn("share", F.col("count") / total)


def global_std(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sample standard deviation of each column as one row."""
    return df.agg(*[F.stddev_samp(c).alias(c) for c in cols])


def describe_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles: one row per column."""
    long = df.select(*[F.col(c).cast("double") for c in cols]).unpivot([], list(cols), "column", "v")
    basic = long.groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    quartiles = _quartile_columns(quantiles_exact(df, cols, [0.25, 0.5, 0.75]), ["column"])
    return basic.join(quartiles, "column", "left")


def _quartile_columns(quantiles: DataFrame, by: list[str]) -> DataFrame:
    pick = lambda q: F.max(F.when(F.col("q") == q, F.col("quantile")))
    return quantiles.groupBy(*by).agg(pick(0.25).alias("q25"), pick(0.5).alias("q50"), pick(0.75).alias("q75"))


def histogram_fixed_bins(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Counts in equal-width bins between the extremes; the last bin includes the maximum."""
    v = F.col(col).cast("double")
    edges = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    ranged = df.filter(v.isNotNull()).select(v.alias("v"), edges.alias("e"))
    width = F.col("e.hi") - F.col("e.lo")
    place = F.when(width == 0, 0).otherwise(F.floor((F.col("v") - F.col("e.lo")) / F.nullif(width, F.lit(0.0)) * bins))
    counts = ranged.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("count"))
    return _all_bins(df, counts, bins)


def histogram_by_edges(df: DataFrame, value: Column, edges: list) -> DataFrame:
    """Counts in half-open bins between given edges (numbers or columns), closed at the last edge."""
    edges = [e if isinstance(e, Column) else F.lit(e) for e in edges]
    inside = (value >= edges[0]) & (value <= edges[-1])
    place = reduce(lambda a, e: a + (value >= e).cast("int"), edges[1:-1], F.lit(0))
    counts = df.filter(inside).groupBy(place.alias("bin")).agg(F.count("*").alias("count"))
    return _all_bins(df, counts, len(edges) - 1)


def _all_bins(df: DataFrame, counts: DataFrame, bins: int) -> DataFrame:
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").fillna(0, ["count"])


def box_stats(df: DataFrame, col: str, by: list[str] = ()) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and outlier count per group."""
    by = list(by)
    rows = df.select(*by, F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    quartiles = _quartile_columns(exact_quantiles(rows, "v", [0.25, 0.5, 0.75], by), by)
    if by:
        boxed = rows.join(quartiles, by)
    else:
        boxed = rows.withColumn("_q", quartiles.select(F.struct("q25", "q50", "q75")).scalar()).select("v", "_q.*")
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = (F.col("v") >= F.col("q25") - reach) & (F.col("v") <= F.col("q75") + reach)
    return boxed.groupBy(*by).agg(
        F.max("q25").alias("q25"), F.max("q50").alias("q50"), F.max("q75").alias("q75"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.sum((~inside).cast("int")).alias("outliers"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson coefficients of every pair in one aggregate: (col_a, col_b, corr)."""
    pairs = list(combinations_with_replacement(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"c{i}").alias("corr"))
             for i, (a, b) in enumerate(pairs)]
    return one.select(F.inline(F.array(*cells)))


def pearson_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Coefficient of one pair with its sample size and t statistic."""
    one = df.agg(F.corr(a, b).alias("r"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n"))
    return one.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))


def pearson_p_value(r: float, n: int) -> float:
    """Two-sided probability of a coefficient at least this large without correlation."""
    degrees = n - 2
    if degrees <= 0:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    if degrees > 10_000:
        return math.erfc(abs(r) * math.sqrt(degrees / (1 - r * r)) / math.sqrt(2))
    # With t = sqrt(degrees) * tan(angle) the density of Student's t is a power of the cosine.
    angle = np.linspace(0, math.pi / 2, 200_001)
    density = np.cos(angle) ** (degrees - 1)
    tail = np.linspace(math.asin(abs(r)), math.pi / 2, 200_001)
    return float(np.trapezoid(np.cos(tail) ** (degrees - 1), tail) / np.trapezoid(density, angle))


def normalise_by_max_abs(df: DataFrame, col: str, by: str) -> DataFrame:
    """Value over the largest absolute value of its group.

    The maxima are combined before the shuffle and joined back; a window over
    the group would pull all rows of a parameter into one task.
    """
    peaks = df.groupBy(by).agg(F.max(F.abs(col)).alias("_peak"))
    return df.join(peaks, by, "left").withColumn(f"{col}_normalised", F.try_divide(F.col(col), F.col("_peak"))).drop(
        "_peak")


def crosstab_labels(df: DataFrame, real: str, pred: str) -> DataFrame:
    """Counts of predicted 0 and 1 for each real label."""
    return df.groupBy(F.col(real).alias("real")).agg(
        F.sum((F.col(pred) == 0).cast("int")).alias("pred_0"), F.sum((F.col(pred) == 1).cast("int")).alias("pred_1"))


def rmse_mae_by_param(df: DataFrame, params: list[str], suffix: str = "_pred") -> DataFrame:
    """Root mean square, mean absolute and ninth-decile absolute error per parameter, over the rows scored."""
    errors = df.select(*[F.abs(F.col(p) - F.col(p + suffix)).alias(p) for p in params]).unpivot(
        [], list(params), "param", "error")
    basic = errors.groupBy("param").agg(
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg("error").alias("mae"))
    decile = exact_quantiles(errors, "error", [0.9], ["param"]).select("param", F.col("quantile").alias("decile9"))
    return basic.join(decile, "param", "left")


def cumulative_share(df: DataFrame, col: str, order: str, head: int = 4) -> DataFrame:
    """Running sum of a short table of shares, with the remainder after ``head`` rows as ``others``."""
    running = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    shares = df.withColumns({"cumulative": F.sum(col).over(running), "_rank": F.row_number().over(W.orderBy(order))})
    rest = F.sum(F.when(F.col("_rank") > head, F.col(col))).over(W.partitionBy())
    return shares.withColumn("others", F.coalesce(rest, F.lit(0.0))).drop("_rank")


def top_k_rows(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """First rows of an order: each task keeps its best ``k``, nothing else is moved."""
    return df.orderBy(*order).limit(k)


def sort_series(df: DataFrame, order: list[str] = ("station_id", "day")) -> DataFrame:
    """Total order for an export; operators in between never need it."""
    return df.orderBy(*order)


def threshold_histogram(df: DataFrame, param: str) -> DataFrame:
    """Absolute corrections other than 0 in bins of tenths of the raw standard deviation."""
    std = df.agg(F.stddev_samp(raw(param))).scalar()
    diff = F.abs(F.col(raw(param)) - F.col(param))
    corrected = df.filter(diff != 0).select(diff.alias("d"), std.alias("std"))
    return histogram_by_edges(corrected, F.col("d"), [F.col("std") * (i * 0.1) for i in range(11)])
