"""Scaling by statistics of one aggregate, attached as scalars or joined per station."""

from pyspark.sql import Column, DataFrame, functions as F


def _packed(df: DataFrame, cols: list[str], a, b) -> DataFrame:
    return df.agg(*[F.struct(a(c).alias("a"), b(c).alias("b")).alias(c) for c in cols])


def _attach(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """The one row of ``stats`` as a struct column, by a scalar subquery."""
    return df.withColumn("_stats", stats.select(F.struct(*cols)).scalar())


def _stat(c: str, part: str) -> Column:
    return F.col(f"_stats.`{c}`.{part}")


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population deviation over all rows; a constant column becomes 0."""
    stats = _packed(df, cols, F.avg, F.stddev_pop)
    scaled = {c: (F.col(c) - _stat(c, "a")) / _unit(_stat(c, "b")) for c in cols}
    return _attach(df, stats, cols).withColumns(scaled).drop("_stats")


def _unit(deviation: Column) -> Column:
    return F.when(deviation == 0, F.lit(1.0)).otherwise(deviation)


def zscore_train_stats(df: DataFrame, cols: list[str], is_train: Column, by: str | None = None) -> DataFrame:
    """Scale all rows by the mean and deviation of the training rows.

    Over one series the deviation is the sample one and 0 counts as 1. With
    ``by`` each group has its own statistics and the population deviation.
    """
    train = df.filter(is_train)
    if by is None:
        stats = _packed(train, cols, F.avg, F.stddev_samp)
        scaled = {c: (F.col(c) - _stat(c, "a")) / _unit(_stat(c, "b")) for c in cols}
        return _attach(df, stats, cols).withColumns(scaled).drop("_stats")
    stats = train.groupBy(by).agg(F.struct(*[
        F.struct(F.avg(c).alias("a"), F.stddev_pop(c).alias("b")).alias(c) for c in cols]).alias("_stats"))
    scaled = {c: F.try_divide(F.col(c) - _stat(c, "a"), _stat(c, "b")) for c in cols}
    return df.join(stats, by, "left").withColumns(scaled).drop("_stats")


def minmax_stats(train: DataFrame, cols: list[str]) -> DataFrame:
    """Smallest and largest training value of each column: one row of structs."""
    return _packed(train, cols, F.min, F.max)


def minmax_apply(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """Training range to 0..1; a constant column becomes 0."""
    scaled = {c: (F.col(c) - _stat(c, "a")) / _unit(_stat(c, "b") - _stat(c, "a")) for c in cols}
    return _attach(df, stats, cols).withColumns(scaled).drop("_stats")


def minmax_scale(df: DataFrame, cols: list[str], is_train: Column) -> DataFrame:
    return minmax_apply(df, minmax_stats(df.filter(is_train), cols), cols)


def minmax_inverse(df: DataFrame, stats: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """Back to original units; ``suffix`` picks prediction columns of the same parameters."""
    restored = {c + suffix: F.col(c + suffix) * _unit(_stat(c, "b") - _stat(c, "a")) + _stat(c, "a") for c in cols}
    return _attach(df, stats, cols).withColumns(restored).drop("_stats")
