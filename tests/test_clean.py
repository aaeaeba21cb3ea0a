from datetime import date

import pytest
from pyspark.sql import functions as F

from gaugewarden.operators import clean, joins, labels, profile
from gaugewarden.plans import flows
from gaugewarden.schema import MEASUREMENTS
from gaugewarden.sources import scan_measurements_csv, scan_stations_csv, write_partitioned

from .conftest import rows

LONG = "station_id int, param string, day date, value double, raw_value double, status int, mode int"
D = date(2020, 2, 28)


def test_fill_comes_before_the_sentinel(spark):
    df = spark.createDataFrame([(1, "TN", D, 5.0, None, 1, 1), (2, "TN", D, 5.0, -999.0, 1, 1), (3, "TN", D, 5.0, 4.0, 1, 1)], LONG)
    out = clean.null_sentinel(clean.fill_raw_from_validated(df))
    assert rows(out, "station_id", "raw_value") == [(1, 5.0), (2, None), (3, 4.0)]


def test_smallest_mode_wins_and_unknown_mode_comes_last(spark):
    df = spark.createDataFrame([(1, "GLOT", D, float(v), None, 1, m) for v, m in ((10, 3), (11, 1), (12, None), (13, 2))]
                               + [(2, "GLOT", D, 9.0, None, 1, None)], LONG)
    out = clean.dedup_by_priority(clean.fill_mode_priority(df), order=["mode"])
    assert rows(out, "station_id", "value", "mode") == [(1, 11.0, 1), (2, 9.0, 4)]


def test_both_ways_to_the_wide_table_agree(spark):
    df = spark.createDataFrame([(s, p, D, float(m * 10 + s), None, 1, m) for s in (1, 2) for p in ("TN", "TX") for m in (2, 1, 3)
                                if (s, p) != (2, "TX")], LONG)
    apart = clean.pivot_long_to_wide(clean.dedup_by_priority(df, order=["mode"]), ["TN", "TX"])
    together = clean.dedup_and_pivot(df, ["TN", "TX"], ["mode"])
    assert rows(apart) == rows(together) == [(1, D, 11.0, 11.0, None, None), (2, D, 12.0, None, None, None)]


def test_label_thresholds_nulls_and_refill(spark):
    # Raw values 0 and 10 give a sample deviation of about 5.4, so the threshold is about 0.54.
    data = [(1, D, 10.0, 0.0), (2, D, 10.0, 10.3), (3, D, 10.0, None), (4, D, None, 10.0), (5, D, 10.0, 10.0)]
    out = labels.label_anomalies(spark.createDataFrame(data, "station_id int, day date, TN double, TN_origine double"), ["TN"])
    assert rows(out, "station_id", "TN_anomaly", "TN_origine", "anomaly") == [
        (1, 1, 0.0, 1), (2, 0, 10.0, 0), (3, 0, 10.0, 0), (4, 1, None, 1), (5, 0, 10.0, 0)]


def test_degenerate_deviation_flags_nothing(spark):
    out = labels.label_anomalies(spark.createDataFrame([(1, D, 1.0, 5.0)], "station_id int, day date, TN double, TN_origine double"), ["TN"])
    assert out.first()["TN_anomaly"] == 0
    constant = spark.createDataFrame([(i, D, 3.0, 3.0) for i in range(3)], "station_id int, day date, TN double, TN_origine double")
    assert labels.label_anomalies(constant, ["TN"]).agg(F.sum("anomaly")).first()[0] == 0


def test_correction_flags_differ_on_unknown_values(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 2.0), (3, 1.0, None)], "id int, value double, raw_value double")
    assert rows(labels.correction_flag(df), "id", "correction") == [(1, 0), (2, 1), (3, 1)]
    assert rows(labels.correction_flag(df, null_is_diff=False), "id", "correction") == [(1, 0), (2, 1), (3, 0)]


def test_leap_day_is_day_60_on_a_circle_of_366(spark):
    out = labels.add_season(spark.createDataFrame([(date(2020, 2, 29),), (date(2020, 12, 31),)], "day date"))
    got = rows(out, "jourjulien", "day_cos")
    assert got[0][0] == 366 and got[0][1] == pytest.approx(1.0) and got[1][0] == 60


def test_repeated_station_ids_do_not_double_rows(spark):
    df = spark.createDataFrame([(625, D), (700, D), (999, D)], "station_id int, day date")
    st = spark.createDataFrame([(625, 10), (625, 10), (700, 20)], "station_id int, Altitude int")
    assert rows(joins.join_station_attrs(df, st, ["Altitude"])) == [(625, D, 10), (700, D, 20)]
    assert joins.join_spatial_left(df, st, ["Altitude"]).count() == 3


def test_rain_classes_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.5, 0.6, 5.0, 50.0, 501.0)], "RR double")
    got = [r["RR_class"] for r in clean.rain_classes(df, "RR").orderBy("RR").collect()]
    assert got == ["paspluie", "tresfaible", "faible", "faible", "fort", None]


def test_gappy_stations_go_entirely(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 2.0)], "station_id int, TN double")
    assert rows(clean.drop_gappy_stations(df, ["TN"])) == [(2, 2.0)]


def test_nan_in_a_file_becomes_null(spark, tmp_path):
    (tmp_path / "m.csv").write_text("codearvalis;libellecourt;datemesure;valeur;valeurorigine;idstatut;idmodeobtention\n"
                                    "269;TX;2010-01-01;0.6;;1;2.0\n269;TN;2010-01-01;NaN;-999;1;\n")
    got = scan_measurements_csv(spark, str(tmp_path / "m.csv"))
    assert got.columns == MEASUREMENTS.fieldNames()
    assert rows(got, "param", "value", "raw_value", "mode") == [("TN", None, -999.0, None), ("TX", 0.6, None, 2)]


def test_station_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Station;Nom;Latitude;Longitude;Altitude;En Service;Frequence;Parametres;Lambert93x;Lambert93y\n"
                                    "9151;Somewhere;48.4;2.2;150;O;H;TN TX;640000;6800000\n")
    got = clean.derive_department(clean.stations_open(scan_stations_csv(spark, str(tmp_path / "s.csv")), "En Service")).first()
    assert (got["station_id"], got["department"], got["Altitude"]) == (9151, 91, 150)


def test_columns_are_found_by_name(spark, tmp_path):
    """An index column in front and another order move no value."""
    (tmp_path / "s.csv").write_text(";Station;Altitude;Nom;Latitude;Longitude;En Service;Frequence;Parametres;Lambert93y;Lambert93x\n"
                                    "0;9151;150;Somewhere;48.4;2.2;O;H;TN TX;6800000;640000\n")
    got = scan_stations_csv(spark, str(tmp_path / "s.csv")).first()
    assert (got["station_id"], got["Nom"], got["Latitude"], got["Lambert93x"]) == (9151, "Somewhere", 48.4, 640000.0)
    (tmp_path / "m.csv").write_text("param;station_id;day;value;raw_value;status\nTX;1;2010-01-01;0.5;;1\n")
    with pytest.raises(ValueError, match="mode"):
        scan_measurements_csv(spark, str(tmp_path / "m.csv"))
    (tmp_path / "m.csv").write_text("param;station_id;day;value;raw_value;status;mode\nTX;1;2010-01-01;warm;;1;2\n")
    with pytest.raises(Exception, match="warm|MALFORMED"):
        scan_measurements_csv(spark, str(tmp_path / "m.csv")).collect()


def test_periods_are_folders_that_prune(spark, tmp_path):
    df = spark.createDataFrame([(date(y, 6, 1), y) for y in range(2010, 2025)], "day date, y int")
    write_partitioned(df, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p")).filter("period = '2013-2015'")
    assert rows(back, "y") == [(2013,), (2014,), (2015,)]
    assert "PartitionFilters: [isnotnull(period" in back._jdf.queryExecution().executedPlan().toString()


def test_null_keys_and_ratios(spark):
    df = spark.createDataFrame([(D, 1), (D, 0), (D, None)], "day date, anomaly int")
    assert rows(profile.daily_anomaly_rate(df)) == [(D, 1, 2, 0.5)]


def test_flow_from_raw_to_labels(spark):
    long = [(s, p, date(2020, 1, 1 + d), 10.0 + d, 30.0 if (s, d) == (1, 3) else None, 1, 1)
            for s in (1, 2) for p in ("TN", "TX") for d in range(10)]
    long += [(3, "TN", D, 1.0, None, 1, 1)]
    st = spark.createDataFrame([(1, 5, 0.0, 0.0), (2, 6, 1.0, 1.0), (3, 7, 2.0, 2.0)],
                               "station_id int, Altitude int, Lambert93x double, Lambert93y double")
    out = flows.labelled_measurements(spark.createDataFrame(long, LONG), st, ["TN", "TX"])
    assert out.count() == 20
    assert rows(out.filter("anomaly > 0"), "station_id", "anomaly", "TN_origine") == [(1, 2, 30.0)]
