"""Detectors that flag large differences between a value and its prediction."""

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import flag
from ..operators.evaluate import any_param
from ..operators.quantiles import exact_quantiles, quantiles_exact
from ..operators.scale import minmax_apply, minmax_inverse, minmax_stats, zscore_train_stats
from ..operators.series import input_label_windows
from ..session import stage_table


def fit_each_from_rest(train: DataFrame, params: list[str], meta: list[str]) -> dict[str, dict[str, float]]:
    """Least-squares weights that predict each parameter from the others and the metadata.

    One pass adds up the products of all column pairs; the small systems of
    equations are then solved on the driver. Incomplete rows are left out.
    """
    cols = [*params, *meta]
    terms = {**{c: F.col(c).cast("double") for c in cols}, "1": F.lit(1.0)}
    names = list(terms)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = train.na.drop(subset=cols).agg(
        *[F.sum(terms[names[i]] * terms[names[j]]).alias(f"g{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((len(names), len(names)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"g{i}_{j}"] or 0.0
    weights = {}
    for k, p in enumerate(params):
        rest = [i for i in range(len(names)) if i != k]
        solved, *_ = np.linalg.lstsq(gram[np.ix_(rest, rest)], gram[rest, k], rcond=None)
        weights[p] = {names[i]: float(w) for i, w in zip(rest, solved)}
    return weights


def linear(weights: dict[str, float]) -> Column:
    """A weighted sum of columns as a plain expression."""
    total = F.lit(weights.get("1", 0.0))
    for c, w in weights.items():
        if c != "1":
            total = total + F.col(c) * w
    return total


def reconstruction_residual(train: DataFrame, df: DataFrame, params: list[str], meta: list[str],
                            q: float = 0.9) -> DataFrame:
    """Predict parameters from one another, flag scaled residuals above the training quantile ``q``.

    Adds ``{p}_pred`` in original units, ``{p}_residual`` in training ranges,
    ``{p}_anomaly_pred`` and ``anomaly_pred``.
    """
    cols = [*params, *meta]
    stats = minmax_stats(train, cols)
    fitted = train.sparkSession.createDataFrame([stats.first()], stats.schema)
    scaled_train = minmax_apply(train, fitted, cols)
    weights = fit_each_from_rest(scaled_train, params, meta)
    residuals = {f"{p}_residual": F.abs(linear(weights[p]) - F.col(p)) for p in params}
    limits = {r["column"]: r["quantile"] for r in quantiles_exact(
        scaled_train.withColumns(residuals), list(residuals), [q]).collect()}

    kept = df.withColumns({f"_{c}": F.col(c) for c in cols})
    scored = minmax_apply(kept, fitted, cols).withColumns(residuals).withColumns(
        {f"{p}_pred": linear(weights[p]) for p in params})
    scored = minmax_inverse(scored, fitted, params, "_pred")
    scored = scored.withColumns({f"{p}_anomaly_pred": flag(F.col(f"{p}_residual") > limits[f"{p}_residual"])
                                 for p in params})
    return any_param(scored, params).withColumns({c: F.col(f"_{c}") for c in cols}).drop(*[f"_{c}" for c in cols])


def flat_windows(windows: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Windows as one feature vector and a label, without those that hold a null."""
    values = F.flatten(F.transform("inputs", lambda r: F.array(*[r[c] for c in cols])))
    flat = windows.select("station_id", "last_day", values.alias("_v"), F.try_element_at("labels", F.lit(-1))[label].alias("label"))
    complete = flat.filter(F.col("label").isNotNull() & ~F.exists("_v", lambda v: v.isNull()))
    return complete.select("station_id", "last_day", array_to_vector("_v").alias("features"), "label")


def linear_forecast(windows: DataFrame, cols: list[str], label: str) -> tuple[LinearRegressionModel, DataFrame]:
    """Least-squares model of the last label from the inputs, and its predictions on the windows.

    Fitting and scoring read the windows several times, so they are written once.
    """
    flat = stage_table(flat_windows(windows, cols, label), "windows")
    model = LinearRegression(solver="normal", regParam=0.0).fit(flat)
    return model, model.transform(flat).withColumnRenamed("prediction", "pred")


def spatial_forecast_residual(train: DataFrame, test: DataFrame, cols: list[str], label: str, input_width: int = 10,
                              q: float = 0.5) -> DataFrame:
    """Forecast a parameter from own and neighbour values of the days before; flag large residuals.

    Columns are scaled by training statistics, unknown values count as the
    mean, and the limit is a quantile of the training residuals. The first
    ``input_width`` rows of each series have no forecast.
    """
    both = train.withColumn("_train", F.lit(True)).unionByName(test.withColumn("_train", F.lit(False)))
    observed = both.filter(F.col(label).isNotNull())
    scaled = zscore_train_stats(observed, cols, F.col("_train")).fillna(0.0, cols)
    windows = lambda part: input_label_windows(scaled.filter(part), cols, input_width, 1, 1, [label])
    model, fitted = linear_forecast(windows(F.col("_train")), cols, label)
    residual = F.abs(F.col("label") - F.col("pred"))
    limit = exact_quantiles(fitted.withColumn("residual", residual), "residual", [q]).first()["quantile"]
    predicted = model.transform(flat_windows(windows(~F.col("_train")), cols, label)).withColumnRenamed("prediction", "pred")
    scored = predicted.withColumn("residual", residual)
    return scored.select("station_id", F.col("last_day").alias("day"), "label", "pred", "residual",
                         flag(F.col("residual") > limit).alias("anomaly_pred"))


def rmse_threshold_flags(scored: DataFrame) -> DataFrame:
    """Flag residuals above the root mean square error of the same forecast."""
    rmse = scored.agg(F.sqrt(F.avg(F.col("residual") * F.col("residual")))).scalar()
    return scored.withColumn("anomaly_pred", flag(F.col("residual") > rmse))


def assemble(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip").transform(df)
