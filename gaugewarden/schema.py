"""Declared schemas and fixed values of the domain."""

from pyspark.sql import types as T

# Parameter codes, names of station attributes and season, suffix of raw columns, sentinels.
PARAMS = ["ETP", "GLOT", "RR", "TN", "TX"]
META_FEATURES = ["Altitude", "Lambert93x", "Lambert93y", "day_sin", "day_cos"]
RAW_SUFFIX = "_origine"
MISSING_RAW = -999
LOWEST_PRIORITY = 4
ANOMALY_FACTOR = 0.1
# Half of the labelling thresholds of ETP, GLOT, TN, TX.
SMALL_RESIDUALS = [0.09, 41.5, 0.3, 0.4]
# Rain class edges (right closed) and names.
RAIN_EDGES = [-1, 0, 0.5, 5, 15, 50, 500]
RAIN_NAMES = ["paspluie", "tresfaible", "faible", "moyen", "fort", "extreme"]

KEYS = ["station_id", "day"]

# Column names of the measurement files and the names used here.
FILE_COLUMNS = {"codearvalis": "station_id", "libellecourt": "param", "datemesure": "day", "valeur": "value",
                "valeurorigine": "raw_value", "idstatut": "status", "idmodeobtention": "mode"}

MEASUREMENTS = T.StructType([
    T.StructField("station_id", T.IntegerType()),
    T.StructField("param", T.StringType()),
    T.StructField("day", T.DateType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("raw_value", T.DoubleType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("mode", T.DoubleType()),
])

# Column names of the station file.
STATIONS = T.StructType([
    T.StructField("Station", T.IntegerType()),
    T.StructField("Nom", T.StringType()),
    T.StructField("Latitude", T.DoubleType()),
    T.StructField("Longitude", T.DoubleType()),
    T.StructField("Altitude", T.IntegerType()),
    T.StructField("En Service", T.StringType()),
    T.StructField("Frequence", T.StringType()),
    T.StructField("Parametres", T.StringType()),
    T.StructField("Lambert93x", T.DoubleType()),
    T.StructField("Lambert93y", T.DoubleType()),
])


def raw(param: str) -> str:
    """Name of the raw column that goes with a validated column."""
    return param + RAW_SUFFIX


def results_schema(params: list[str]) -> T.StructType:
    """Schema of a detector result file for the given parameters."""
    doubles = [*params, *map(raw, params), "day_sin", "day_cos", *(f"{p}_difference" for p in params),
               "Altitude", "Lambert93x", "Lambert93y", "anomaly_score"]
    flags = [*(f"{p}_anomaly" for p in params), "anomaly", "is_test", "anomaly_pred",
             *(f"{p}_anomaly_pred" for p in params)]
    return T.StructType(
        [T.StructField("station_id", T.IntegerType()), T.StructField("day", T.DateType())]
        + [T.StructField(c, T.DoubleType()) for c in doubles]
        + [T.StructField(c, T.IntegerType()) for c in flags]
    )
