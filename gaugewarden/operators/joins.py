"""Joins of measurements with stations, intervals and detector results."""

from pyspark.sql import DataFrame, functions as F

from ..schema import KEYS
from .profile import station_validity


def one_per_station(stations: DataFrame) -> DataFrame:
    """Stations without repeated ids, which would double measurements; the first row by its attributes stays."""
    rest = [c for c in stations.columns if c != "station_id"]
    best = stations.groupBy("station_id").agg(F.min(F.struct(*rest)).alias("_s"))
    return best.select("station_id", *[F.col(f"_s.{c}").alias(c) for c in rest])


def join_station_attrs(df: DataFrame, stations: DataFrame, cols: list[str]) -> DataFrame:
    """Inner join of station attributes; rows of unknown stations go."""
    return df.join(one_per_station(stations.select("station_id", *cols)), "station_id")


def join_spatial_left(df: DataFrame, stations: DataFrame,
                      cols: list[str] = ("Lambert93x", "Lambert93y", "Altitude", "cluster")) -> DataFrame:
    """Replace spatial columns by those of ``stations``; rows of unknown stations stay."""
    right = one_per_station(stations.select("station_id", *cols))
    return df.drop(*cols).join(right, "station_id", "left")


def join_detector_results(left: DataFrame, right: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Columns of a second detector, matched by station and day."""
    return left.join(right, list(keys), "left")


def join_on_common_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on every column name the two sides share."""
    return left.join(right, [c for c in left.columns if c in right.columns])


def join_validity_interval(stations: DataFrame, df: DataFrame) -> DataFrame:
    """First and last measured day of each station that has measurements."""
    return stations.join(station_validity(df), "station_id")
