"""Connected components of a table of links, in rounds that survive the loss of executors."""

from pyspark.sql import DataFrame, functions as F

from ..session import drop_path, scratch_path


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, root) per linked node that is not itself the smallest of its component.

    Rounds of large stars and small stars: every node sends its larger, then
    its smaller neighbours to the smallest one it knows, until only stars to
    the roots are left. Each round is written to the shared folder, so no
    plan grows and a lost executor costs one round. The smallest neighbours
    are written before they are joined, so that the join reads plain shuffles,
    of which Spark splits the crowded ones.
    """
    spark = links.sparkSession
    written: list[str] = []

    def stage(df: DataFrame, name: str) -> DataFrame:
        written.append(scratch_path(spark, name))
        df.write.parquet(written[-1])
        return spark.read.schema(df.schema).parquet(written[-1])

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    first = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct()
    edges = stage(first, "edges")
    before = state(edges)
    while before[0]:
        old = written[:]
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "lowest")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large.where("a != b"), "large")
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        moved = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = state(edges)
        for path in old:
            drop_path(spark, path)
        del written[:len(old)]
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
