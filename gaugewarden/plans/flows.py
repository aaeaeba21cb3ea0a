"""From raw measurements to labelled features, and prepare, train and check of a detector."""

from pyspark.sql import DataFrame, functions as F

from ..detectors import DETECTORS
from ..functions import flag
from ..operators import clean, evaluate, joins, labels, profile
from ..schema import PARAMS, RAW_SUFFIX
from ..session import stage_table


def wide_measurements(long: DataFrame, params: list[str] = PARAMS, order: list[str] = ("mode",)) -> DataFrame:
    """Deduplicated measurements, one row per station and day."""
    steps = (clean.fill_raw_from_validated, clean.null_sentinel, clean.fill_mode_priority)
    cleaned = clean.filter_params(long, params)
    for step in steps:
        cleaned = cleaned.transform(step)
    return clean.dedup_and_pivot(cleaned, params, order)


def labelled_measurements(long: DataFrame, stations: DataFrame, params: list[str] = PARAMS,
                          wide_path: str | None = None) -> DataFrame:
    """From raw measurements to labelled features."""
    return label_wide(wide_measurements(long, params), stations, params, wide_path)


def label_wide(wide: DataFrame, stations: DataFrame, params: list[str], wide_path: str | None = None) -> DataFrame:
    """Complete stations with season, labels and station attributes.

    The wide table is written once: the gap check, the deviations and the
    labels each read a few of its columns instead of repeating the pivot.
    """
    wide = stage_table(wide, "wide", wide_path)
    complete = clean.drop_gappy_stations(wide, params)
    labelled = labels.label_anomalies(labels.add_season(complete), params)
    return joins.join_station_attrs(labelled, stations, ["Altitude", "Lambert93x", "Lambert93y"])


def prepare(name: str, df: DataFrame, stations: DataFrame | None = None, spatial: bool = False,
            seed: int = 42) -> DataFrame:
    """Columns a detector needs, if it needs any."""
    step = DETECTORS[name].prepare
    return df if step is None else step(df, stations, spatial, seed)


def train(name: str, df: DataFrame, params: list[str] = PARAMS, spatial: bool = False, seed: int = 42) -> DataFrame:
    """Detector results on the rows kept for testing."""
    binary = df.withColumn("anomaly", flag(F.col("anomaly") > 0)) if name != "dbscan" else df
    return DETECTORS[name].train(binary, params, spatial, seed).filter(F.col("is_test") == 1)


def trained_params(results: DataFrame) -> list[str]:
    """Parameters a result table has predictions for."""
    suffix = "_anomaly_pred"
    return [c.removesuffix(suffix) for c in results.columns if c.endswith(suffix) and not c.endswith(RAW_SUFFIX)]


def check(results: DataFrame) -> DataFrame:
    """Confusion counts and metrics per parameter."""
    return evaluate.metrics_per_param(results, trained_params(results))


def check_global(results: DataFrame) -> DataFrame:
    """Confusion counts and metrics of the whole row's verdict, on the rows kept for testing; any anomaly counts as one."""
    tested = results.filter(F.col("is_test") == 1).withColumn("anomaly", flag(F.col("anomaly") > 0))
    return evaluate.classification_metrics(tested, "anomaly", "anomaly_pred")


def check_classes(results: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support of both classes of the whole row's verdict, with the counts of both predictions."""
    tested = results.filter(F.col("is_test") == 1).withColumn("anomaly", flag(F.col("anomaly") > 0))
    table = profile.crosstab_labels(tested, "anomaly", "anomaly_pred").withColumnRenamed("real", "label")
    return evaluate.class_report(tested, "anomaly", "anomaly_pred").join(table, "label", "left").fillna(0, ["pred_0", "pred_1"])


def station_follow_up(df: DataFrame, station: int, year: int) -> DataFrame:
    """One station and year, in order, for a report."""
    return clean.filter_station(df, station, year).orderBy("day")
