"""Station clusters and principal components with Spark ML on standardised columns."""

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..operators.scale import standardise
from .residual import assemble

PLACE = ["Lambert93x", "Lambert93y", "Altitude"]


def cluster_stations(stations: DataFrame, k: int = 4, seed: int = 42, cols: list[str] = PLACE) -> DataFrame:
    """Adds ``cluster``, from k-means on standardised position and altitude."""
    points = assemble(standardise(stations.select("station_id", *cols), cols), cols)
    model = KMeans(k=k, seed=seed).fit(points)
    found = model.transform(points).select("station_id", F.col("prediction").alias("cluster"))
    return stations.drop("cluster").join(found, "station_id", "left")


def choose_k(stations: DataFrame, ks: list[int] = range(2, 21), seed: int = 42, cols: list[str] = PLACE) -> DataFrame:
    """Inertia and silhouette for each number of clusters."""
    points = assemble(standardise(stations.select("station_id", *cols), cols), cols).cache()
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed).fit(points)
        rows.append((k, model.summary.trainingCost, ClusteringEvaluator().evaluate(model.transform(points))))
    points.unpersist()
    return stations.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def pca_fit(df: DataFrame, cols: list[str], k: int):
    points = assemble(standardise(df, cols), cols)
    return PCA(k=k, inputCol="features", outputCol="components").fit(points), points


def pca_variance(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of the variance explained by each component."""
    model, _ = pca_fit(df, cols, len(cols))
    shares = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)]
    return df.sparkSession.createDataFrame(shares, "component int, share double")


def pca_project(df: DataFrame, cols: list[str], k: int = 2) -> DataFrame:
    """Rows on the first ``k`` components of their standardised columns (signs are arbitrary)."""
    model, points = pca_fit(df, cols, k)
    at = vector_to_array("components")
    return model.transform(points).withColumns({f"pc{i + 1}": at[i] for i in range(k)}).drop("features", "components")
