"""Labelling of human corrections and comparison of labels with predictions."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import flag, row_sum, seasonal
from ..schema import ANOMALY_FACTOR, SMALL_RESIDUALS, raw


def add_season(df: DataFrame) -> DataFrame:
    """Day of the year, its place on the yearly circle, and the year."""
    sin, cos = seasonal(F.col("day"))
    return df.withColumns({"jourjulien": F.dayofyear("day"), "day_sin": sin, "day_cos": cos, "year": F.year("day")})


def std_thresholds(df: DataFrame, params: list[str], factor: float = ANOMALY_FACTOR) -> DataFrame:
    """One row: ``factor`` times the sample deviation of each raw column."""
    return df.agg(*[(F.stddev_samp(raw(p)) * factor).alias(p) for p in params])


def label_anomalies(df: DataFrame, params: list[str], factor: float = ANOMALY_FACTOR) -> DataFrame:
    """Difference, flag and refilled raw value per parameter, and the number of flagged parameters.

    A difference above the threshold is an anomaly. Without one the raw value
    takes the validated value, and what is still unknown then is flagged too.
    """
    return label_with(df, params, std_thresholds(df, params, factor).select(F.struct(*params)).scalar())


def label_with(df: DataFrame, params: list[str], thresholds: Column) -> DataFrame:
    """Labels for given thresholds, a struct column with one field per parameter."""
    base = df.withColumn("_limit", thresholds).withColumns(
        {f"{p}_difference": F.col(raw(p)) - F.col(p) for p in params})
    over = {p: flag(F.abs(f"{p}_difference") > F.col(f"_limit.{p}")) for p in params}
    kept = {p: F.when(over[p] == 1, F.col(raw(p))).otherwise(F.col(p)) for p in params}
    flags = {f"{p}_anomaly": F.when(kept[p].isNull(), 1).otherwise(over[p]) for p in params}
    labelled = base.withColumns({**flags, **{raw(p): kept[p] for p in params}})
    return labelled.withColumn("anomaly", row_sum(list(flags)).cast("int")).drop("_limit")


def correction_flag(df: DataFrame, null_is_diff: bool = True) -> DataFrame:
    """1 where raw and validated value differ, and the signed difference validated minus raw.

    An unknown value counts as different or, with ``null_is_diff=False``, as equal.
    """
    same = F.col("value").eqNullSafe(F.col("raw_value")) & F.col("value").isNotNull()
    changed = ~same if null_is_diff else F.abs(F.col("value") - F.col("raw_value")) > 0
    return df.withColumns({"correction": flag(changed), "difference": F.col("value") - F.col("raw_value")})


def threshold_variants(df: DataFrame, params: list[str], factors: list[float]) -> DataFrame:
    """Rows over the threshold per parameter and factor, all factors in one pass."""
    stats = df.agg(F.struct(*[F.stddev_samp(raw(p)).alias(p) for p in params])).scalar()
    with_std = df.select(stats.alias("_std"), *[F.abs(F.col(raw(p)) - F.col(p)).alias(p) for p in params])
    counts = with_std.agg(*[F.sum(flag(F.col(p) > F.col(f"_std.{p}") * f)).alias(f"{p}_{i}")
                            for p in params for i, f in enumerate(factors)])
    cells = [F.struct(F.lit(p).alias("param"), F.lit(float(f)).alias("factor"), F.col(f"{p}_{i}").alias("anomalies"))
             for p in params for i, f in enumerate(factors)]
    return counts.select(F.inline(F.array(*cells)))


def fixed_threshold(df: DataFrame, param: str, limit: float) -> DataFrame:
    """Flag where raw and validated value differ by more than a fixed amount."""
    return df.withColumn(f"{param}_anomaly", flag(F.abs(F.col(raw(param)) - F.col(param)) > limit))


def suppress_small_residuals(df: DataFrame, params: list[str], limits: list[float] = SMALL_RESIDUALS,
                             pred: str = "_pred", hit: str = "_anomaly_pred") -> DataFrame:
    """In rows predicted anomalous, keep only parameters whose residual exceeds its limit."""
    kept = {p: flag(F.abs(F.col(p + pred) - F.col(raw(p))) > limit) for p, limit in zip(params, limits)}
    anomalous = F.col("anomaly_pred") == 1
    out = df.withColumns({p + hit: F.when(anomalous, kept[p]).otherwise(F.col(p + hit)) for p in params})
    return out.withColumn("anomaly_pred", flag(row_sum([p + hit for p in params]) > 0))


def detector_vote(df: DataFrame, cols: list[str]) -> DataFrame:
    """Number of detectors that flag a row; a detector without a result does not count."""
    return df.withColumn("votes", row_sum(cols).cast("int"))
