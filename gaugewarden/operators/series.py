"""Row-order operators over station series.

A series may be long, so no window spans a whole station. Rows first get
their exact position: ranks inside a calendar year plus the sizes of earlier
years. Blocks of consecutive positions then carry copies of the few rows just
outside them, and every lag or sliding window runs within a block.

All operators expect one row per station and day, as the deduplicated table has.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK = 1024


def series_positions(df: DataFrame, by: list[str] = ("station_id",), order: str = "day", length: str = "n") -> DataFrame:
    """Add ``pos`` (1-based place in the series) and ``length``, the length of the series.

    Operators below call the length ``_n``, as a parameter may be called N.

    The year counts are combined before their shuffle and have one row per
    series and year; the rows themselves move once, by series and year.
    """
    by = list(by)
    dated = df.withColumn("_year", F.year(order))
    sizes = dated.groupBy(*by, "_year").agg(F.count("*").alias("_c"))
    series = W.partitionBy(*by)
    earlier = series.orderBy("_year").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_year", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"),
                           F.sum("_c").over(series).alias(length))
    ranked = dated.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_year").orderBy(order)))
    return ranked.join(offsets, [*by, "_year"]).withColumn("pos", F.col("_before") + F.col("_r")).drop(
        "_year", "_r", "_before")


def with_halo(df: DataFrame, before: int, block: int | None = None) -> DataFrame:
    """Rows in blocks of positions, with the ``before`` rows ahead of each block copied into it.

    Adds ``_block`` and ``_own`` (false for copies). Needs ``pos``.
    """
    block = max(block or BLOCK, before, 1)
    home = F.floor((F.col("pos") - 1) / block)
    tail = (F.col("pos") - 1) % block >= block - before
    targets = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_home", home).withColumn("_block", F.explode(targets)).withColumn(
        "_own", F.col("_block") == F.col("_home")).drop("_home")


def within_block(by: list[str] = ("station_id",)):
    return W.partitionBy(*by, "_block").orderBy("pos")


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_block", "_own")


def lag_features(df: DataFrame, params: list[str], n: int = 5) -> DataFrame:
    """``{p}_1`` .. ``{p}_n``: the values of the previous rows of the same station."""
    rows = with_halo(series_positions(df, length="_n"), n)
    lags = {f"{p}_{i}": F.lag(p, i).over(within_block()) for p in params for i in range(1, n + 1)}
    return own_rows(rows.withColumns(lags)).drop("pos", "_n")


def series_breaks(df: DataFrame, trim: int = 5) -> DataFrame:
    """Cut series at missing days and drop the first ``trim`` rows of each run.

    ``run_key`` (day minus position) is constant exactly within a run without gaps.
    """
    rows = with_halo(series_positions(df, length="_n"), trim)
    previous = F.lag("day").over(within_block())
    rows = rows.withColumn("_starts", (previous.isNull() | (previous != F.date_sub("day", 1))).cast("int"))
    recent = F.max("_starts").over(within_block().rowsBetween(-(trim - 1), 0))
    kept = own_rows(rows.withColumn("_recent", recent)).filter("_recent = 0")
    return kept.withColumn("run_key", F.expr("date_sub(day, cast(pos as int))")).drop("_starts", "_recent", "pos", "_n")


def sequence_windows(df: DataFrame, cols: list[str], n: int, contiguous: bool = False) -> DataFrame:
    """``n`` consecutive rows as ``x`` (array of structs) and the row after them as ``y``.

    Rows are consecutive by position; ``contiguous`` also wants no day missing.
    The station and day are those of ``y``.
    """
    rows = with_halo(series_positions(df, length="_n"), n)
    past = within_block().rowsBetween(-n, -1)
    built = rows.withColumns({"x": F.collect_list(F.struct(*cols)).over(past), "_first": F.min("day").over(past)})
    full = own_rows(built).filter(F.size("x") == n)
    if contiguous:
        full = full.filter(F.datediff("day", "_first") == n)
    return full.select("station_id", "day", "x", F.struct(*cols).alias("y"))


def input_label_windows(df: DataFrame, cols: list[str], input_width: int, label_width: int, shift: int,
                        labels: list[str] | None = None) -> DataFrame:
    """Sliding windows of ``input_width + shift`` rows split into ``inputs`` and ``labels``."""
    return _windows(series_positions(df, length="_n"), cols, input_width, label_width, shift, labels, ["station_id"])


def _windows(positioned: DataFrame, cols: list[str], input_width: int, label_width: int, shift: int,
             labels: list[str] | None, by: list[str], keep: list[str] = ()) -> DataFrame:
    total = input_width + shift
    rows = with_halo(positioned, total - 1)
    span = within_block(by).rowsBetween(-(total - 1), 0)
    built = rows.withColumns({"_w": F.collect_list(F.struct(*cols)).over(span), "first_day": F.min("day").over(span)})
    full = own_rows(built).filter(F.size("_w") == total)
    label_rows = F.slice("_w", total - label_width + 1, label_width)
    picked = label_rows if labels is None else F.transform(label_rows, lambda r: F.struct(*[r[c].alias(c) for c in labels]))
    return full.select(*by, *keep, "first_day", F.col("day").alias("last_day"),
                       F.slice("_w", 1, input_width).alias("inputs"), picked.alias("labels"))


def densify_grid(df: DataFrame, step: str = "1 day", keys: DataFrame | None = None) -> DataFrame:
    """Every station on every day between the extremes, with nulls where nothing was measured."""
    bounds = df.agg(F.struct(F.min("day").alias("lo"), F.max("day").alias("hi"))).scalar()
    stations = (keys if keys is not None else df).select("station_id").distinct()
    calendar = F.sequence(F.col("_b.lo"), F.col("_b.hi"), F.expr(f"INTERVAL {step}"))
    grid = stations.withColumn("_b", bounds).select("station_id", F.explode(calendar).alias("day"))
    return grid.join(df, ["station_id", "day"], "left")


def multi_series_windows(df: DataFrame, labels: list[str], regressors: list[str], input_width: int, label_width: int,
                         shift: int, static: list[str] = (), normalise: bool = False, train: Column | None = None) -> DataFrame:
    """Input and label windows of every station over the dense daily grid.

    With ``normalise`` each station is scaled by the mean and population
    deviation of its rows that meet ``train`` (all, unless given), so that the
    others stay unseen; without such rows its values are null. On the grid the position follows from the calendar, so no ranking is needed.
    """
    cols = [*labels, *regressors]
    grid = densify_grid(df.select("station_id", "day", *cols))
    seen = lambda c: F.col(c) if train is None else F.when(train, F.col(c))
    fitted = [F.max(c).alias(c) for c in static]
    if normalise:
        fitted += [F.avg(seen(c)).alias(f"_m_{c}") for c in cols] + [F.stddev_pop(seen(c)).alias(f"_s_{c}") for c in cols]
    if fitted:
        grid = grid.join(df.groupBy("station_id").agg(*fitted), "station_id")
    if normalise:
        grid = grid.withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in cols})
    first = df.agg(F.min("day")).scalar()
    positioned = grid.withColumn("pos", F.datediff("day", first) + 1)
    return _windows(positioned, cols, input_width, label_width, shift, list(labels), ["station_id"], static)


def split_by_position(df: DataFrame, fractions: tuple[float, float] = (0.7, 0.9)) -> DataFrame:
    """``train`` up to the first fraction of each series, ``val`` up to the second, ``test`` after it."""
    rows = series_positions(df)
    upto = lambda f: F.col("pos") <= F.floor(F.col("n") * F.lit(f))
    part = F.when(upto(fractions[0]), "train").when(upto(fractions[1]), "val").otherwise("test")
    return rows.withColumn("split", part)


def persistence_forecast(df: DataFrame, param: str) -> DataFrame:
    """Predict each value by the one before it; the first of a series has no prediction."""
    lagged = lag_features(df.select("station_id", "day", param), [param], 1)
    return lagged.withColumnRenamed(f"{param}_1", f"{param}_pred").filter(F.col(f"{param}_pred").isNotNull())


def forecast_errors(df: DataFrame, param: str) -> DataFrame:
    """Mean squared and mean absolute error of a forecast."""
    error = F.col(param) - F.col(f"{param}_pred")
    return df.agg(F.count(error).alias("rows"), F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"))


def rank_within_group(df: DataFrame, by: list[str], order: list[str | Column], k: int) -> DataFrame:
    """The ``k`` first rows of each group; tasks drop rows beyond ``k`` before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)
