"""Session settings and the shared scratch folder."""

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch of rows on its way to a Python worker, which holds it several times over.
BATCH_BYTES = 8 << 20


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own. ``shared``: folder for scratch tables."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gaugewarden")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    return (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the place the driver has it at; other places take ``addPyFile``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def bound_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of at most ``BATCH_BYTES``, however long they are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= BATCH_BYTES:  # what a user has set in other units stays
        spark.conf.set(name, str(BATCH_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    Where that is unset, a folder below the warehouse is used if driver and
    executors are one machine or the warehouse is in a shared store. On a cluster whose
    warehouse is a plain local path this is an error: each machine would see its own rows only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not is_shared(spark.sparkContext.master, warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{warehouse}/scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def is_shared(master: str, folder: str) -> bool:
    """Whether all tasks of a session surely see one ``folder``."""
    one_machine = master.startswith("local") and not master.startswith("local-cluster")
    return one_machine or ("://" in folder and not folder.startswith("file:"))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stage_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Used where several later scans would otherwise repeat an expensive
    shuffle; the written table also survives the loss of executors.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
