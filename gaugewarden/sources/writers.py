"""Writing partitioned measurements, feature matrices, statistics and run logs."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import period_label
from .versions import publish, published, read_versions


def write_partitioned(df: DataFrame, path: str, years: int = 3, first_year: int = 2010) -> None:
    """One folder per period of ``years`` years, in a single pass.

    The rebalance hint lets adaptive execution split a period that holds most
    of the rows and merge small ones, so neither one huge nor many tiny files.
    """
    (df.withColumn("period", period_label(F.col("day"), years, first_year))
       .hint("rebalance", "period")
       .write.mode("overwrite").partitionBy("period").parquet(path))


def write_feature_matrix(df: DataFrame, cols: list[str], path: str, keys: list[str] = ()) -> None:
    """Columns in a fixed order as one array per row; keys stay so that rows can be traced back."""
    matrix = df.select(*keys, F.array(*[F.col(c).cast("double") for c in cols]).alias("features"))
    matrix.write.mode("overwrite").parquet(path)


def save_fitted_stats(stats: DataFrame, path: str) -> str:
    """Fitted statistics (a handful of rows) as a new version of the table at ``path``; earlier ones stay readable."""
    return publish(stats, path)


def load_fitted_stats(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The latest published statistics, or those of a ``version``."""
    return read_versions(spark, path, [version] if version else published(spark, path)[-1:]).drop("version")


def append_run_log(df: DataFrame, path: str) -> str:
    """Append one record per candidate, all of a run or none."""
    return publish(df, path)


def read_run_log(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The latest record of each candidate, which ``key`` names; a run that is repeated replaces its records and adds none."""
    log = read_versions(spark, path, published(spark, path))
    rows = [c for c in log.columns if c != "version"]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rows), "version").alias("_r")).select("_r.*")
