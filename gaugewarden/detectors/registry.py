"""Detectors by name, with the checks they run before training."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.joins import join_spatial_left
from ..schema import META_FEATURES, raw
from . import cluster, density, isoforest

SPATIAL = [*META_FEATURES[1:3], META_FEATURES[0], "cluster"]


def check_columns(df: DataFrame, params: list[str], spatial: bool = False) -> None:
    """Fail early when a table was not prepared."""
    wanted = [f"{p}_anomaly" for p in params] + (SPATIAL if spatial else [])
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"prepare the table first, missing: {', '.join(missing)}")


@dataclass(frozen=True)
class Detector:
    """``prepare`` adds columns, ``train`` adds ``is_test``, ``anomaly_pred`` and ``{p}_anomaly_pred``."""

    train: Callable[..., DataFrame]
    prepare: Callable[..., DataFrame] | None = None


DETECTORS: dict[str, Detector] = {}


def register(name: str, detector: Detector) -> None:
    DETECTORS[name] = detector


def _features(params: list[str]) -> list[str]:
    return [*META_FEATURES, *map(raw, params)]


def _prepare_forest(df: DataFrame, stations: DataFrame, spatial: bool, seed: int) -> DataFrame:
    if not spatial or all(c in df.columns for c in SPATIAL):
        return df
    return join_spatial_left(df, cluster.cluster_stations(stations, seed=seed))


def _train_forest(df: DataFrame, params: list[str], spatial: bool, seed: int) -> DataFrame:
    check_columns(df, params, spatial)
    # an unknown raw value counts as 0, as the reports have it; stations must have their attributes
    fill = {raw(p): 0.0 for p in params} | {"cluster": -1.0}
    return isoforest.detect(df, params, _features(params), spatial, seed, fill)


def _train_density(df: DataFrame, params: list[str], spatial: bool, seed: int) -> DataFrame:
    check_columns(df, params)
    return density.detect(df, params, _features(params))


register("isolationForest", Detector(_train_forest, _prepare_forest))
register("dbscan", Detector(_train_density))
