"""Small tables in versions: written under a new name and published by renaming a manifest.

A version is a folder ``version=<number>-<id>`` below the table's path. It
counts from the moment its manifest, an empty file, has its final name, so a run
that breaks off or is repeated by Spark leaves nothing that a reader would see. No
version is ever overwritten; readers keep what they hold until ``drop_versions``.
"""

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = re.compile(r"manifest-(\d{10}-[0-9a-f]{32})$")


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def published(spark: SparkSession, path: str) -> list[str]:
    """Names of the published versions, oldest first."""
    target, fs = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
    return sorted(m.group(1) for m in map(MANIFEST.match, names) if m)


def publish(df: DataFrame, path: str) -> str:
    """Write ``df`` as a version that follows all published ones; versions written at the same time all stay, in the order of their ids."""
    spark, own = df.sparkSession, uuid.uuid4().hex
    target, fs = _files(spark, path)
    last = published(spark, path)
    name = f"{int(last[-1][:10]) + 1 if last else 1:010d}-{own}"
    df.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={name}")
    child = lambda n: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target, n)
    fs.create(child(f"_writing-{own}"), False).close()
    if not fs.rename(child(f"_writing-{own}"), child(f"manifest-{name}")):
        raise OSError(f"version {name} of {path} could not be published")
    return name


def read_versions(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The rows of the named versions with their ``version``."""
    if not names:
        raise FileNotFoundError(f"no published version below {path}")
    return spark.read.option("basePath", path).option("mergeSchema", True).parquet(*[f"{path}/version={n}" for n in names])


def drop_versions(spark: SparkSession, path: str, keep: int) -> None:
    """Delete all but the ``keep`` latest versions: first the manifest, then the rows."""
    target, fs = _files(spark, path)
    child = lambda n: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target, n)
    for name in published(spark, path)[:-keep if keep else None]:
        fs.delete(child(f"manifest-{name}"), False)
        fs.delete(child(f"version={name}"), True)
