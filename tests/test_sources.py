"""Versions of small tables: nothing half written, nothing doubled, nothing taken from a reader."""

import uuid

import pytest

from gaugewarden.session import is_shared, scratch_path
from gaugewarden.sources import append_run_log, drop_versions, load_fitted_stats, read_run_log, save_fitted_stats
from gaugewarden.sources.versions import published

from .conftest import rows


def test_new_statistics_leave_the_old_ones_to_their_readers(spark):
    path = scratch_path(spark, "stats")
    with pytest.raises(FileNotFoundError):
        load_fitted_stats(spark, path)
    first = save_fitted_stats(spark.createDataFrame([("a", 1.0)], "c string, m double"), path)
    held = load_fitted_stats(spark, path)
    save_fitted_stats(spark.createDataFrame([("a", 2.0), ("b", 3.0)], "c string, m double"), path)
    assert rows(held) == [("a", 1.0)]
    assert rows(load_fitted_stats(spark, path)) == [("a", 2.0), ("b", 3.0)]
    assert rows(load_fitted_stats(spark, path, first)) == [("a", 1.0)]
    drop_versions(spark, path, 1)
    assert rows(load_fitted_stats(spark, path)) == [("a", 2.0), ("b", 3.0)] and len(published(spark, path)) == 1


def test_a_broken_write_is_not_seen(spark):
    path = scratch_path(spark, "stats")
    save_fitted_stats(spark.createDataFrame([(1,)], "m int"), path)
    spark.createDataFrame([(9,)], "m int").write.parquet(f"{path}/version=0000000002-{uuid.uuid4().hex}")
    assert rows(load_fitted_stats(spark, path)) == [(1,)]
    save_fitted_stats(spark.createDataFrame([(2,)], "m int"), path)
    assert rows(load_fitted_stats(spark, path)) == [(2,)]


def test_a_repeated_run_replaces_its_records(spark):
    path = scratch_path(spark, "log")
    run = lambda recall, *eps: append_run_log(spark.createDataFrame([(e, 5, recall) for e in eps], "eps double, m int, recall double"), path)
    run(0.5, 0.1, 0.2)
    run(0.7, 0.1, 0.2)
    run(0.9, 0.3)
    assert rows(read_run_log(spark, path, ["eps", "m"])) == [(0.1, 5, 0.7), (0.2, 5, 0.7), (0.3, 5, 0.9)]


def test_scratch_tables_need_a_shared_folder(spark):
    assert is_shared("local[8]", "file:/tmp/w") and is_shared("yarn", "hdfs://a/w") and is_shared("spark://m:7077", "s3a://b/w")
    assert not any(is_shared(m, f) for m in ("yarn", "spark://m:7077", "local-cluster[2,1,1024]") for f in ("file:/tmp/w", "/tmp/w", "file:///tmp/w"))
