"""Shuffle files of staged tables."""

import glob
import time

from pyspark.sql import functions as F

from textveil.plans import storage


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}


def test_stage_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(storage._CLEANUP, "false")
    counted = spark.range(20_000).groupBy((F.col("id") % 5_000).alias("k")).count()
    staged = storage.stage(counted, "cleaned")
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(storage._CLEANUP) == setting
    assert staged.count() == 5_000 and counted.count() == 5_000
    # a table that is run outside keeps its shuffles, as it may be run again
    assert counted.collect() and counted.collect()


def test_setting_comes_back_after_a_failed_write(spark):
    setting = spark.conf.get(storage._CLEANUP, "false")
    try:
        storage.stage(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), "failed")
    except Exception:  # noqa: BLE001
        pass
    else:
        raise AssertionError
    assert spark.conf.get(storage._CLEANUP) == setting and not storage._cleaning
