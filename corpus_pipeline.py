"""From raw documents to packed sequences: each stage reads all that the one before has kept."""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from gaugewarden.llm import exact_dedup, language_id, mixing, queries, simhash
from gaugewarden.session import bound_batches, share_package, stage_table


def bounded(stage):
    """The stage with batches of bounded size, also where it is called by itself."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that the corpus names: without letters, or too far from every centroid."""
    return language_id.recognised(docs)


@bounded
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each normalised text."""
    return exact_dedup.keep_first_copies(docs)


@bounded
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints."""
    return simhash.first_of_groups(docs, written=True)


@bounded
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Uses each document as often as the fitted rate says; domains come from the labels table."""
    return mixing.sampled(docs, queries.domain_labels(spark, sf_dir))


@bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents; one row per piece."""
    return queries.packed_documents(docs)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]

#: Language ID, mixing and packing are learned or iterative; tests compare run() with a brute-force version instead.
ORACLE_SQL = None



def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written as Parquet and read again."""
    share_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
