"""Partitions follow the grid, numbering shuffles its rows once, and the training matrix is written once."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from outagelens.operators.blocked import sequence_number
from outagelens.operators.resample import grid_rows, hourly_grid
from outagelens import session


@pytest.fixture
def partitions(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    yield lambda: int(spark.conf.get(name))
    spark.conf.set(name, before)


def test_shuffle_partitions_follow_the_hours(spark, partitions, monkeypatch):
    monkeypatch.setattr(session, "PARTITION_ROWS", 100)
    ts = F.expr("timestamp_ntz'2024-01-01 00:30:00' + make_dt_interval(0, cast(id as int) * 1000)")
    readings = spark.range(3).select(F.lit(1).alias("site_id"), ts.alias("ts"), F.lit(2.0).alias("total_load_kw"))
    assert grid_rows(readings) == 2001
    grid = hourly_grid(readings, rules={"total_load_kw": "mean"}, renames={})
    assert partitions() == 21
    assert grid.count() == 2001
    assert session.room_for(spark, 10) == 21  # never lowered


def test_numbering_writes_rows_once_and_shuffles_them_once(spark, tmp_path):
    folder = session.checkpoint_dir(spark)
    before = set(os.listdir(folder))
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("o"), F.lit("x" * 50).alias("wide"))
    d = sequence_number(df, [], ["o"])
    new = set(os.listdir(folder)) - before
    assert len([p for p in new if "wide" in spark.read.parquet(f"{folder}/{p}").columns]) == 1
    # reading the numbered rows shuffles nothing
    assert "Exchange hashpartitioning" not in d._jdf.queryExecution().toString()
    assert d.where("o <> row_idx").count() == 0 and d.count() == 1000


def test_numbering_by_key(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 2000).alias("o"))
    got = sequence_number(df, ["k"], ["o"]).toPandas().sort_values(["k", "o"])
    assert (got.row_idx == got.groupby("k").cumcount()).all()


def test_tasks_of_large_grids_read_bounded_bytes(spark, partitions, monkeypatch):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, "64MB")
        session.room_for(spark, session.PARTITION_ROWS)  # one partition's rows: left alone
        assert [spark.conf.get(n) for n in names] == ["64MB"] * 2
        session.room_for(spark, session.PARTITION_ROWS + 1)
        assert [int(spark.conf.get(n)) for n in names] == [session.TASK_BYTES] * 2
        spark.conf.set(names[0], "1000")
        session.room_for(spark, session.PARTITION_ROWS + 1)
        assert spark.conf.get(names[0]) == "1000"  # never raised
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def test_training_matrix_is_written_without_the_rows_own_features(spark, tmp_path):
    from outagelens.operators import align as AL
    from outagelens.plans import catalogue_train as T
    from outagelens.plans import pipeline as P

    day = "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int))"
    spark.range(400).selectExpr("id as event_id", f"{day} as ts", "id % 3 as user_id", "elt(1 + id % 6, 'click', 'view', 'purchase', 'signup', "
                                "'error', 'view') as event_type", "cast(id * 7919 % 101 as double) as value", "'{\"k\": 40}' as props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(3).selectExpr("id as c_custkey", "int(id) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(9).selectExpr("id as o_orderkey", "id % 3 as o_custkey", "'F' as o_orderstatus", "date'2023-05-01' as o_orderdate",
                              "'1-URGENT' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    folder = session.checkpoint_dir(spark)
    before = set(os.listdir(folder))
    train, test, cols = T.model_data(spark, str(tmp_path))
    new = [spark.read.parquet(f"{folder}/{p}").columns for p in set(os.listdir(folder)) - before]
    (matrix,) = [c for c in new if "load_rolling_24h" in c]
    assert not {"hour", "hour_sin", "month_cos", "solar_ratio", "heat_stress"} & set(matrix)
    want = P.features(spark, str(tmp_path))
    assert cols == AL.feature_columns(want)
    key = ["site_id", "hidx", *cols]
    got = train.select(key).unionAll(test.select(key))
    assert got.exceptAll(want.select(key)).count() == 0 and got.count() == want.count()


def test_fill_with_halo_equals_the_plain_fill_and_windows_shuffle_nothing(spark):
    from pyspark.sql import Window
    from outagelens.operators import blocked as B
    from outagelens.operators.fill import gap_fill

    # two series over several blocks of 8; known values are rare, one series begins in a block's last rows
    v = F.when(F.col("id") * 7919 % 11 < 2, (F.col("id") * 31 % 17).cast("double"))
    df = spark.range(-50, 70).select(F.lit("a").alias("k"), F.col("id").alias("i"), v.alias("v"), F.when(F.col("id") % 13 == 5, F.col("id")).alias("c")).unionAll(
        spark.range(14, 45).select(F.lit("b"), F.col("id"), F.when(F.col("id") == 39, 4.0), F.col("id")))
    plain = gap_fill(df, ["k"], "i", ["v"], ["c"], block=8)
    haloed = gap_fill(df, ["k"], "i", ["v"], ["c"], block=8, halo=3)
    got = B.drop_halo(haloed).drop(B.HALO_BLOCK)
    assert got.count() == df.count() and got.exceptAll(plain.select(got.columns)).count() == 0
    sums = lambda w: {"s": F.sum("v").over(w.rowsBetween(-3, 0)), "p": F.lag("c", 3).over(w)}
    want = plain.withColumns(sums(Window.partitionBy("k").orderBy("i")))
    rolled = B.blocked_rolling(haloed, ["k"], "i", sums, halo=3, block=8)
    assert rolled.exceptAll(want.select(rolled.columns)).count() == 0
    exchanges = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(rolled) == exchanges(haloed)
    assert exchanges(B.blocked_rolling(plain, ["k"], "i", sums, halo=3, block=8)) > exchanges(plain)


def test_load_changes_made_later_are_the_same(spark):
    from outagelens.operators import features as FE

    df = spark.range(60).select(F.lit(1).alias("site_id"), F.col("id").alias("hidx"),
                                F.when(F.col("id") % 7 == 3, 0.0).when(F.col("id") % 11 != 2, F.sqrt("id")).alias(FE.LOAD))
    want = FE.window_features(df)
    got = FE.window_features(df, changes=False)
    assert not set(FE.LOAD_CHANGES) & set(got.columns)
    assert FE.load_changes(got).select(want.columns).exceptAll(want).count() == 0


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    from outagelens.llm.common import stored

    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in folders for _, _, found in os.walk(d) for f in found if f.startswith("shuffle_")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for write in (session.materialised, stored):
        before, setting = files(), spark.conf.get(name, None)
        df = spark.range(1000).repartition(3, "id")
        out = write(df, "room")
        for _ in range(50):
            if not files() - before:
                break
            time.sleep(0.1)
        assert not files() - before and spark.conf.get(name, None) == setting
        # what was shuffled for it can be shuffled again
        assert out.count() == df.count() == 1000
