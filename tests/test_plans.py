"""What the plans must and must not do, whatever the data size."""

import pytest

from gaugewarden import fixtures as fx
from gaugewarden.catalogue import QUERIES
from gaugewarden.operators import clean, labels, profile, series


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


JOINING = """active_neighbours_daily attach_active_neighbours attach_columns box_stats correction_box_stats densify_grid
    describe_table drop_gappy_stations join_detector_results join_on_common_columns join_spatial_left join_station_attrs
    label_anomalies matrix_to_pairs multi_series_windows nearest_neighbours neighbour_lag_features normalise_by_max_abs
    pairwise_distance rmse_mae_by_param split_by_year_station standardise zscore_by_station""".split()


@pytest.mark.parametrize("name", JOINING)
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_wide_table_takes_one_shuffle(spark, sf_dir):
    text = plan(fx.e_wide(spark, sf_dir))
    assert text.count("Exchange hashpartitioning") == 1


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = clean.filter_params(fx.e_long(spark, sf_dir), ["click"]).select("station_id", "value")
    text = plan(df)
    assert "EqualTo(event_type,click)" in text
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in text


def test_copies_are_combined_before_the_shuffle(spark, sf_dir):
    text = plan(clean.dedup_by_priority(fx.e_clean(spark, sf_dir)))
    assert "partial_min" in text and "Window" not in text


def test_no_window_spans_a_whole_series(spark, sf_dir):
    wide = fx.e_wide(spark, sf_dir)
    for df in (series.lag_features(wide, ["click"], 2), series.sequence_windows(wide, ["click"], 2)):
        for line in plan(df).splitlines():
            if "Window [" in line and ("lag(" in line or "collect_list" in line or "row_number" in line):
                assert "_block" in line or "_year" in line


def test_labels_stay_out_of_python(spark, sf_dir):
    text = plan(profile.daily_anomaly_rate(labels.label_anomalies(fx.e_wide(spark, sf_dir), fx.E_PARAMS)))
    assert "Python" not in text and "Pandas" not in text
