"""Confusion counts, detector metrics and choice among candidates."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import flag, row_sum, safe_ratio
from .quantiles import quantiles_exact

METRICS = ["accuracy", "precision", "recall", "f1", "roc", "mcc"]


def confusion_class(df: DataFrame, real: str, pred: str) -> DataFrame:
    r, p = F.col(real) == 1, F.col(pred) == 1
    return df.withColumn("outcome", F.when(r & p, "TP").when(r, "FN").when(p, "FP").otherwise("TN"))


def confusion_counts(real: Column, pred: Column) -> list[Column]:
    """Aggregates TP, TN, FP, FN of two 0/1 columns."""
    cell = lambda r, p, name: F.sum(((real == r) & (pred == p)).cast("long")).alias(name)
    return [cell(1, 1, "TP"), cell(0, 0, "TN"), cell(0, 1, "FP"), cell(1, 0, "FN")]


def metrics_from_counts(df: DataFrame) -> DataFrame:
    """Metrics from TP, TN, FP, FN columns; a ratio over nothing is 0.

    The area under the curve of hard labels is the mean of both recalls.
    """
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("TP", "TN", "FP", "FN"))
    recall, precision = safe_ratio(tp, tp + fn), safe_ratio(tp, tp + fp)
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return df.withColumns({
        "accuracy": safe_ratio(tp + tn, tp + tn + fp + fn),
        "precision": precision,
        "recall": recall,
        "f1": safe_ratio(2 * tp, 2 * tp + fp + fn),
        "roc": (recall + safe_ratio(tn, tn + fp)) / 2,
        "mcc": safe_ratio(tp * tn - fp * fn, spread),
    })


def classification_metrics(df: DataFrame, real: str, pred: str, by: list[str] = ()) -> DataFrame:
    """Confusion counts and metrics, over all rows or per group."""
    return metrics_from_counts(df.groupBy(*by).agg(*confusion_counts(F.col(real), F.col(pred))))


def class_report(df: DataFrame, real: str, pred: str) -> DataFrame:
    """Precision, recall, f1 and support of both classes."""
    one = df.agg(*confusion_counts(F.col(real), F.col(pred)))
    rows = [F.struct(F.lit(label).alias("label"), hit.alias("h"), false.alias("f"), missed.alias("m"))
            for label, hit, false, missed in ((0, F.col("TN"), F.col("FN"), F.col("FP")),
                                              (1, F.col("TP"), F.col("FP"), F.col("FN")))]
    h, f, m = F.col("h"), F.col("f"), F.col("m")
    return one.select(F.inline(F.array(*rows))).select(
        "label", safe_ratio(h, h + f).alias("precision"), safe_ratio(h, h + m).alias("recall"),
        safe_ratio(2 * h, 2 * h + f + m).alias("f1"), (h + m).alias("support"))


def metrics_per_param(df: DataFrame, params: list[str]) -> DataFrame:
    """Metrics of ``{p}_anomaly`` against ``{p}_anomaly_pred`` for each parameter, from one pass."""
    pairs = F.array(*[F.struct(F.lit(p).alias("param"), F.col(f"{p}_anomaly").alias("real"),
                               F.col(f"{p}_anomaly_pred").alias("pred")) for p in params])
    return classification_metrics(df.select(F.inline(pairs)), "real", "pred", ["param"])


def quantile_threshold_sweep(train: DataFrame, test: DataFrame, params: list[str], qs: list[float],
                             suffix: str = "_residual", real: str = "anomaly") -> DataFrame:
    """Metrics on test rows when any residual exceeds its training quantile, for each fraction.

    The thresholds are a few numbers; the test rows are read once and counted
    for all fractions in the same aggregate.
    """
    cols = [p + suffix for p in params]
    limits = {(r["column"], r["q"]): r["quantile"] for r in quantiles_exact(train, cols, qs).collect()}
    rows = test.select(flag(F.col(real) > 0).alias("real"), *cols)
    sums = []
    for i, q in enumerate(qs):
        hit = flag(_any([F.col(c) > limits[c, float(q)] for c in cols]))
        sums += [s.alias(f"{name}_{i}") for s, name in zip(confusion_counts(F.col("real"), hit), ("TP", "TN", "FP", "FN"))]
    counted = rows.agg(*sums)
    cells = [F.struct(F.lit(float(q)).alias("q"), *[F.col(f"{n}_{i}").alias(n) for n in ("TP", "TN", "FP", "FN")])
             for i, q in enumerate(qs)]
    return metrics_from_counts(counted.select(F.inline(F.array(*cells))))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def any_param(df: DataFrame, params: list[str], suffix: str = "_anomaly_pred", name: str = "anomaly_pred") -> DataFrame:
    """1 where any parameter is flagged."""
    return df.withColumn(name, flag(row_sum([p + suffix for p in params]) > 0))


def error_residual_extremes(df: DataFrame, params: list[str], observed: str = "", pred: str = "_pred",
                            real: str = "anomaly", hit: str = "anomaly_pred") -> DataFrame:
    """Largest residual and largest correction per parameter over missed and over false anomalies."""
    r, p = F.col(real) > 0, F.col(hit) == 1
    outcome = F.when(r & ~p, "FN").when(~r & p, "FP")
    wrong = df.withColumn("outcome", outcome).filter(F.col("outcome").isNotNull())
    cells = F.array(*[F.struct(F.lit(c).alias("param"), F.abs(F.col(c + observed) - F.col(c + pred)).alias("residual"),
                               F.abs(F.col(f"{c}_difference")).alias("correction")) for c in params])
    return wrong.select("outcome", F.inline(cells)).groupBy("outcome", "param").agg(
        F.max("residual").alias("max_residual"), F.max("correction").alias("max_correction"))


def grid_report(df: DataFrame) -> DataFrame:
    """Candidates with their confusion counts as shares of the total."""
    total = F.col("TP") + F.col("TN") + F.col("FP") + F.col("FN")
    return df.withColumns({f"{c}_share": safe_ratio(F.col(c), total) for c in ("TP", "TN", "FP", "FN")})


def select_best_candidate(df: DataFrame, min_accuracy: float = 0.7) -> DataFrame:
    """The candidate with the highest recall among those accurate enough."""
    return df.filter(F.col("accuracy") > min_accuracy).orderBy(F.desc("recall"), F.desc("accuracy")).limit(1)
