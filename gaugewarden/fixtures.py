"""Sensor-network tables derived from the given tables, on Spark and as SQL text.

E: ``events`` as daily measurements with gaps, duplicates and corrections.
L: ``lineitem`` as dense quarterly measurements.
S: ``embeddings`` and ``customer`` as the station dimension.
D: embeddings as points, ``labels`` as truth and prediction.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import clean, labels
from .schema import raw

E_PARAMS = ["click", "error", "purchase", "signup", "view"]
E_FORECAST = ["click", "error", "signup", "view"]
L_PARAMS = ["A", "N", "R"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def e_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    corrected = F.when(F.col("k") < 10, F.lit(-999.0)).when(F.col("k") % 5 == 0, F.col("value") + F.col("k")).when(
        F.col("k") % 7 == 0, F.col("value") + 0.5)
    return table(spark, sf_dir, "events").withColumn("k", k).select(
        F.col("user_id").alias("station_id"), F.col("event_type").alias("param"), F.to_date("ts").alias("day"),
        "value", corrected.alias("raw_value"), (F.col("event_id") % 3 + 1).cast("int").alias("status"),
        F.nullif(F.col("event_id") % 4, F.lit(0)).cast("int").alias("mode"), F.col("event_id").alias("row_id"))


def e_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = clean.fill_raw_from_validated(e_long(spark, sf_dir))
    return clean.fill_mode_priority(clean.null_sentinel(filled))


def e_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.dedup_and_pivot(e_clean(spark, sf_dir), E_PARAMS)


def e_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_anomalies(e_wide(spark, sf_dir), E_PARAMS)


def l_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    corrected = F.when(F.col("l_discount") != 0, F.col("l_quantity") * (1 + F.col("l_discount")))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("station_id"), F.col("l_returnflag").alias("param"),
        F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("day"), F.col("l_quantity").alias("value"),
        corrected.alias("raw_value"), F.col("l_linenumber").alias("mode"), F.col("l_orderkey").alias("row_id"),
        F.col("l_partkey").alias("part"))


def l_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = clean.fill_raw_from_validated(l_long(spark, sf_dir))
    return clean.dedup_and_pivot(filled, L_PARAMS, ["mode", "row_id", "part"])


def l_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_gappy_stations(l_wide(spark, sf_dir), L_PARAMS)


def l_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_anomalies(l_dense(spark, sf_dir), L_PARAMS)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations that have measurements in E."""
    place = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("station_id"), (F.element_at("embedding", 1).cast("double") * 500000).alias("Lambert93x"),
        (F.element_at("embedding", 2).cast("double") * 500000).alias("Lambert93y"), F.col("label").alias("region"))
    height = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("station_id"), F.col("c_acctbal").alias("Altitude"))
    everywhere = place.join(height, "station_id").withColumn(
        "in_service", F.when(F.col("region") % 3 == 0, "N").otherwise("O"))
    return clean.semi_anti_membership(everywhere, table(spark, sf_dir, "events").select(
        F.col("user_id").alias("station_id")))


POINT = [f"x{i}" for i in range(1, 65)]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", *[at(i + 1).alias(c) for i, c in enumerate(POINT)])


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and prediction of each labelled document."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") == 0).cast("int").alias("real"), F.col("toxic").alias("pred"))


def e_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with 0 for unknown raw values."""
    return e_features_known(spark, sf_dir).fillna(0.0, [raw(p) for p in E_PARAMS])


def e_features_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw values, known or not, with season and station attributes: what the density and forest detectors use."""
    labelled = labels.add_season(e_label(spark, sf_dir))
    st = stations(spark, sf_dir).select("station_id", "Altitude", "Lambert93x", "Lambert93y")
    return labelled.join(st, "station_id")


FEATURES = [*map(raw, E_PARAMS), "Altitude", "Lambert93x", "Lambert93y", "day_sin", "day_cos"]

# The same tables as DuckDB common table expressions, each built on earlier ones.
_cells = lambda col, ps, suffix="": ", ".join(
    f"max(CASE WHEN param = '{p}' THEN {col} END) AS \"{p}{suffix}\"" for p in ps)


def label_sql(source: str, params: list[str], factor: float = 0.1) -> str:
    """Labelled form of a wide relation."""
    over = {p: f"coalesce(abs({p}_origine - {p}) > {factor} * (SELECT stddev_samp({p}_origine) FROM {source}), false)"
            for p in params}
    flags = {p: f"CASE WHEN {over[p]} OR {p} IS NULL THEN 1 ELSE 0 END" for p in params}
    cols = ", ".join(
        f"{p}, CASE WHEN {over[p]} THEN {p}_origine ELSE {p} END AS {p}_origine, "
        f"{p}_origine - {p} AS {p}_difference, {flags[p]} AS {p}_anomaly" for p in params)
    total = " + ".join(f"{p}_anomaly" for p in params)
    return f"SELECT *, {total} AS anomaly FROM (SELECT station_id, day, {cols} FROM {source})"


CTES = {
    "e": """SELECT user_id AS station_id, event_type AS param, CAST(ts AS DATE) AS day, value,
        CASE WHEN k < 10 THEN -999.0::DOUBLE WHEN k % 5 = 0 THEN value + k WHEN k % 7 = 0 THEN value + 0.5::DOUBLE END AS raw_value,
        CAST(event_id % 3 + 1 AS INTEGER) AS status,
        CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 4 END AS INTEGER) AS mode, event_id AS row_id
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "e_clean": """SELECT station_id, param, day, value, nullif(coalesce(raw_value, value), -999) AS raw_value, status,
        coalesce(mode, 4) AS mode, row_id FROM e""",
    "e_dedup": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
        PARTITION BY station_id, param, day ORDER BY mode, row_id) AS rn FROM e_clean) WHERE rn = 1""",
    "e_wide": f"""SELECT station_id, day, {_cells('value', E_PARAMS)}, {_cells('raw_value', E_PARAMS, '_origine')}
        FROM e_dedup GROUP BY station_id, day""",
    "e_label": label_sql("e_wide", E_PARAMS),
    "l": """SELECT l_suppkey AS station_id, l_returnflag AS param, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS day,
        l_quantity AS value, CASE WHEN l_discount <> 0 THEN l_quantity * (1 + l_discount) END AS raw_value,
        l_linenumber AS mode, l_orderkey AS row_id, l_partkey AS part FROM lineitem""",
    "l_dedup": """SELECT * EXCLUDE (rn) FROM (SELECT * REPLACE (coalesce(raw_value, value) AS raw_value), row_number() OVER (
        PARTITION BY station_id, param, day ORDER BY mode, row_id, part, value, coalesce(raw_value, value)) AS rn FROM l)
        WHERE rn = 1""",
    "l_wide": f"""SELECT station_id, day, {_cells('value', L_PARAMS)}, {_cells('raw_value', L_PARAMS, '_origine')}
        FROM l_dedup GROUP BY station_id, day""",
    "l_dense": """SELECT * FROM l_wide WHERE station_id NOT IN (
        SELECT station_id FROM l_wide WHERE A IS NULL OR N IS NULL OR R IS NULL)""",
    "l_label": label_sql("l_dense", L_PARAMS),
    "st": """SELECT vec_id AS station_id, CAST(list_extract(embedding, 1) AS DOUBLE) * 500000 AS Lambert93x,
        CAST(list_extract(embedding, 2) AS DOUBLE) * 500000 AS Lambert93y, label AS region, c_acctbal AS Altitude,
        CASE WHEN label % 3 = 0 THEN 'N' ELSE 'O' END AS in_service
        FROM embeddings JOIN customer ON c_custkey = vec_id WHERE vec_id IN (SELECT user_id FROM events)""",
    "pairs": """SELECT a.station_id, b.station_id AS other_id, sqrt((a.Lambert93x - b.Lambert93x) * (a.Lambert93x - b.Lambert93x)
        + (a.Lambert93y - b.Lambert93y) * (a.Lambert93y - b.Lambert93y)) / 1000 AS km,
        abs(a.Altitude - b.Altitude) AS altitude_gap FROM st a JOIN st b ON a.station_id <> b.station_id""",
    "near": """SELECT station_id, other_id AS neighbour_id, km, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
        PARTITION BY station_id ORDER BY km, other_id) AS rn FROM pairs) WHERE rn <= 5""",
    "validity": "SELECT station_id, min(day) AS first_day, max(day) AS last_day FROM e GROUP BY station_id",
    "pt": "SELECT vec_id, " + ", ".join(f"CAST(list_extract(embedding, {i + 1}) AS DOUBLE) AS {c}" for i, c in enumerate(POINT))
          + " FROM embeddings",
    "lab": "SELECT doc_id, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS real, toxic AS pred FROM labels",
    "e_known": """SELECT e_label.*, Altitude, Lambert93x, Lambert93y, sin(2 * pi() * dayofyear(day) / 366) AS day_sin,
        cos(2 * pi() * dayofyear(day) / 366) AS day_cos FROM e_label JOIN st USING (station_id)""",
    "e_features": f"""SELECT * REPLACE ({', '.join(f'coalesce({p}_origine, 0) AS {p}_origine' for p in E_PARAMS)}) FROM e_known""",
}
NEEDS = {
    "e": [], "e_clean": ["e"], "e_dedup": ["e_clean"], "e_wide": ["e_dedup"], "e_label": ["e_wide"], "l": [],
    "l_dedup": ["l"], "l_wide": ["l_dedup"], "l_dense": ["l_wide"], "l_label": ["l_dense"], "st": [], "pairs": ["st"], "near": ["pairs"],
    "validity": ["e"], "pt": [], "lab": [], "e_known": ["e_label", "st"], "e_features": ["e_known"],
}


def sql(select: str, *sources: str) -> str:
    """``select`` with the common table expressions it needs in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for s in sources:
        add(s)
    if not order:
        return select
    body = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    for start in ("WITH RECURSIVE ", "WITH "):
        if select.lstrip().startswith(start):
            return f"{start}{body}, {select.lstrip()[len(start):]}"
    return f"WITH {body} {select}"
