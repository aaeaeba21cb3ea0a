"""Reading measurement, station and result files."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import FILE_COLUMNS, MEASUREMENTS, STATIONS


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL: Spark orders NaN above every number, so flags would fire on it."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats})


def _csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str) -> DataFrame:
    """Columns by the names in the header: further columns are ignored, the order is free.

    A column that is missing or a value that is not of its type is an error, never a shifted field.
    """
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    found = spark.read.option("header", True).csv(path, sep=sep).columns
    names = [FILE_COLUMNS.get(n, n) for n in found]
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in schema}
    there = T.StructType([T.StructField(n, kinds.get(FILE_COLUMNS.get(n, n), T.StringType())) for n in found])
    reader = spark.read.schema(there).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    read = reader.option("nullValue", "").option("nanValue", "NaN").csv(path, sep=sep)
    return nan_to_null(read.toDF(*names).select(*[F.col(f"`{f.name}`") for f in schema]))


def scan_measurements_csv(spark: SparkSession, path: str, schema: T.StructType = MEASUREMENTS) -> DataFrame:
    """Long measurements from semicolon separated text with these column names."""
    df = _csv(spark, path, schema, ";")
    return df.withColumn("mode", F.col("mode").cast("int")) if "mode" in df.columns else df


def scan_stations_csv(spark: SparkSession, path: str, schema: T.StructType = STATIONS) -> DataFrame:
    """Station dimension from semicolon separated text, with the id named like in the measurements."""
    return _csv(spark, path, schema, ";").withColumnRenamed("Station", "station_id")


def scan_results_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Detector results, comma separated unless told otherwise."""
    return _csv(spark, path, schema, sep)


def sql_over_file(spark: SparkSession, path: str, sql: str, kind: str | None = None) -> DataFrame:
    """Run ``sql`` over a file or folder, called ``{measurements}`` in it; Parquet scans keep pushdown and pruning.

    ``kind`` is ``csv`` or ``parquet``; unless given, the ending of the path decides.
    """
    kind = kind or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    scan = scan_measurements_csv(spark, path) if kind == "csv" else spark.read.parquet(path)
    return spark.sql(sql, measurements=scan)
