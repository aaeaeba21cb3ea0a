"""Exact deduplication as a stream with keyed state that never expires.

The stream reads the table's files, turns each row into the digest of its
normalised text and keeps one state entry per digest: the smallest stable
identifier, the place of its content (file and row in it) and the number of
rows so far. The state lies on disk (RocksDB, bounded memory) with its changes
logged below the shared folder, so a lost executor or a restarted query goes on
from the last batch. Rows of a batch are combined before they are shuffled.
Rows that hit a digest are then compared with the content at the kept place,
byte by byte.
"""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import scratch_path, stage_table

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Most buckets of digests that are sent to all tasks, as one number each.
BUCKETS = 1 << 20
#: Input for which one more state store is opened: its entries take some hundred megabytes.
BYTES_PER_STORE = 4 << 30
#: Input bytes of one micro-batch.
BATCH_BYTES = 64 << 30


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: str = "text"):
    """Runs of the six white-space characters as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _place(key: str):
    """Order of rows: smallest key first, null keys last; place of the content settles ties of repeated rows."""
    return F.struct(F.col(key).isNull().alias("no_key"), F.col(key).cast("long").alias("id"),
                    F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def update_state(spark: SparkSession, path: str, schema: T.StructType, digest, state_path: str, key: str = "doc_id",
                 batch_bytes: int = BATCH_BYTES, files_per_batch: int | None = None) -> DataFrame:
    """Run the stream over the Parquet files in ``path`` that ``state_path`` has not seen; return all entries.

    Called again with the same ``state_path`` after files were added, it reads
    only those and compares them with everything before. Entries: digest,
    keep (order, identifier and place), n.
    """
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # the number of state partitions stays as it is at the first run; each is a store that reserves some megabytes of disk
    stores = max(spark.sparkContext.defaultParallelism, system.getContentSummary(file).getLength() // BYTES_PER_STORE)
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes)
    if files_per_batch:
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if system.getFileStatus(file).isFile():
        # streams read folders: take the one file's folder and leave out all others
        reader, path = reader.option("pathGlobFilter", file.getName()), file.getParent().toString()
    entries = reader.parquet(path).select(digest.alias("digest"), _place(key).alias("place")).groupBy("digest").agg(
        F.min("place").alias("keep"), F.count("*").alias("n"))

    def write(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{state_path}/changes/batch={batch}")

    with _settings(spark, STATE | {"spark.sql.streaming.internal.stateStore.partitions": str(stores)}):
        query = (entries.writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True)
                 .option("checkpointLocation", f"{state_path}/stream").start())
        query.awaitTermination()
    changed = "digest string, keep struct<no_key: boolean, id: bigint, file: string, row: bigint>, n bigint, batch int"
    try:
        changes = spark.read.schema(changed).parquet(f"{state_path}/changes")
    except Exception as e:  # an empty table makes no batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        changes = spark.createDataFrame([], changed)
    return changes.groupBy("digest").agg(F.min("keep").alias("keep"), F.max("n").alias("n"))


def _bucket(digest):
    return F.pmod(F.xxhash64(digest), F.lit(BUCKETS)).alias("bucket")


def _verdicts(spark: SparkSession, path: str, text: str, key: str, digest, files_per_batch: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows (key, place, text_sha256, keep, n), without keep and n where no other text is equal; and the buckets of digests that repeat.

    Whole texts leave their task only if their bucket has a repeated digest.
    There are ``BUCKETS`` of them at most, so they can be sent to all tasks.
    """
    schema = spark.read.parquet(path).schema
    norm = normalised(text)
    sha = F.sha2(norm, 256)
    digest = sha if digest is None else digest
    entries = update_state(spark, path, schema, digest, scratch_path(spark, "dedup-state"), key, files_per_batch=files_per_batch)
    repeated = stage_table(entries.where("n > 1"), "repeated-digests")
    buckets = stage_table(repeated.select(_bucket("digest")).distinct(), "repeated-buckets")

    rows = spark.read.schema(schema).parquet(path).select(
        F.col(key).alias("key"), _place(key).alias("place"), digest.alias("digest"), sha.alias("text_sha256"), norm.alias("norm"))
    # rows that hit a digest: all bytes are equal if the smallest and the largest text are; copies combine before the shuffle
    hits = rows.select("digest", "norm", _bucket("digest")).join(F.broadcast(buckets), "bucket", "left_semi")
    odd = hits.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low != high").select("digest")
    odd = stage_table(odd, "colliding-digests")
    plain = rows.select("key", "place", "digest", "text_sha256")
    if odd.isEmpty():
        return plain.join(repeated, "digest", "left"), buckets
    collided = rows.join(odd, "digest", "left_semi")
    by_text = stage_table(collided.groupBy("norm").agg(F.min("place").alias("keep"), F.count("*").alias("n")), "groups-by-text")
    settled = collided.join(by_text, "norm").select("key", "place", "digest", "text_sha256", "keep", "n")
    return settled.unionByName(plain.join(odd, "digest", "left_anti").join(repeated, "digest", "left")), buckets


def exact_duplicates(spark: SparkSession, path: str, text: str = "text", key: str = "doc_id", digest=None,
                     files_per_batch: int | None = None) -> DataFrame:
    """One row per row of the Parquet table in ``path``: ``key``, keep_id, group_size, kept, text_sha256 and place.

    Of rows with equal normalised text the one with the smallest key stays,
    null keys last; of repeated rows with one key the first in file order.
    Null texts are empty texts and equal each other. Further columns are not
    read. ``digest`` (a column, by default the SHA-256 of the normalised text)
    may collide: where texts of one digest differ they are grouped anew by their
    whole text.
    """
    verdicts, _ = _verdicts(spark, path, text, key, digest, files_per_batch)
    keep = F.coalesce(F.col("keep"), F.col("place"))
    kind = spark.read.parquet(path).schema[key].dataType
    return verdicts.select(F.col("key").alias(key), keep["id"].cast(kind).alias("keep_id"),
                           F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                           (F.col("place") == keep).alias("kept"), "text_sha256", "place")


def keep_first_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The rows are written to the shared folder first: the stream reads files,
    and the verdict names rows by file and position. Rows in a bucket without
    a repeated digest stay where they are; only the others are joined with the verdict.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "dedup-input")
    docs.write.parquet(path)
    verdicts, buckets = _verdicts(spark, path, text, key, None, None)
    gone = stage_table(verdicts.where("place != keep").select("place.file", "place.row"), "dropped-rows")
    rows = spark.read.schema(docs.schema).parquet(path)
    place = rows["_metadata"]
    marked = rows.select(F.struct(*[rows[f"`{c}`"] for c in docs.columns]).alias("__row"), place["file_path"].alias("__file"),
                         place["row_index"].alias("__index"), _bucket(F.sha2(normalised(text), 256)).alias("__bucket"))
    known = F.broadcast(buckets)
    alone = marked.join(known, F.col("__bucket") == F.col("bucket"), "left_anti")
    crowd = marked.join(known, F.col("__bucket") == F.col("bucket"), "left_semi")
    stay = crowd.join(gone, (F.col("__file") == F.col("file")) & (F.col("__index") == F.col("row")), "left_anti")
    return alone.unionByName(stay).select("__row.*")
