from textveil.plans import storage
from textveil.plans.storage import spread_small


def rows_of_splits(df):
    return sorted(df.rdd.glom().map(len).collect())


def read_in_small_splits(spark, path):
    """The table cut into many more splits than it has row groups."""
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = spark.read.parquet(path)
        df.rdd.getNumPartitions()
        return df, spread_small(df)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_row_group_in_many_splits_is_dealt_out(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(40_000).selectExpr("id", "md5(CAST(id AS STRING)) AS text").coalesce(1).write.parquet(path)
    df, spread = read_in_small_splits(spark, path)
    assert len(rows_of_splits(df)) >= spark.sparkContext.defaultParallelism
    assert max(rows_of_splits(df)) == 40_000
    assert max(rows_of_splits(spread)) <= 2 * 40_000 / spark.sparkContext.defaultParallelism
    assert spread.exceptAll(df).isEmpty() and df.exceptAll(spread).isEmpty()


def test_even_splits_stay_and_long_ones_are_cut(spark, tmp_path, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    path = str(tmp_path / "t")
    spark.range(0, 3_000 * cores, 1, cores).write.parquet(path)
    df = spark.read.parquet(path).repartition(cores)
    assert spread_small(df) is df
    monkeypatch.setattr(storage, "MOST_ROWS", 1_000)
    assert max(rows_of_splits(spread_small(df))) <= 1_000
    assert spread_small(spark.read.parquet(path).where("id < 0")).count() == 0
