"""Pandas-semantics cases (FIXTURES.md section 3) for the custom plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from outagelens.operators.asof import asof_nearest
from outagelens.operators.fill import gap_fill
from outagelens.operators.features import window_features
from outagelens.functions.numeric import rnd


def ts(sec):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=sec)


def test_asof_nearest_ties_and_tolerance(spark):
    left = spark.createDataFrame([(1, ts(t)) for t in (5, 10, 20, 30)], "g long, t timestamp_ntz")
    right = spark.createDataFrame(
        [(1, ts(t), b, i) for i, (t, b) in enumerate([(4, 40), (6, 60), (9, 90), (9, 91), (11, 110), (22, 220), (33, 330)])],
        "g long, t timestamp_ntz, b long, seq long")
    out = asof_nearest(left, right, on="t", by=["g"], tolerance_us=2_000_000, right_cols=["b"], right_order="seq",
                       bucket_us=8_000_000)
    got = {r.t: r.b for r in out.collect()}
    assert [got[ts(t)] for t in (5, 10, 20, 30)] == [40, 91, 220, None]


def test_asof_nearest_bucket_borders(spark):
    # left just after a bucket border must still see the right row just before it
    left = spark.createDataFrame([(1, ts(100)), (1, ts(199))], "g long, t timestamp_ntz")
    right = spark.createDataFrame([(1, ts(99), 1, 0), (1, ts(201), 2, 1)], "g long, t timestamp_ntz, b long, seq long")
    out = asof_nearest(left, right, on="t", by=["g"], tolerance_us=3_000_000, right_cols=["b"], right_order="seq",
                       bucket_us=100_000_000 // 1)
    got = {r.t: r.b for r in out.collect()}
    assert got == {ts(100): 1, ts(199): 2}


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_interpolate_ffill_bfill(spark, block):
    vals = [None, 1.0, None, None, 4.0, None]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "k long, i long, v double")
    out = gap_fill(df, ["k"], "i", linear=["v"], block=block).orderBy("i")
    assert [r.v for r in out.collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


@pytest.mark.parametrize("block", [25, 30, 2048])
def test_rolling_windows_match_unblocked(spark, block):
    import pandas as pd
    n = 200
    vals = [float((i * 37) % 23) for i in range(n)]
    df = spark.createDataFrame([(1, i, v, 1.0, i % 7 == 0 and 1 or 0) for i, v in enumerate(vals)],
                               "site_id long, hidx long, total_load_kw double, grid_availability_ratio double, is_outage int")
    got = window_features(df, block=block).orderBy("hidx").toPandas()
    s = pd.Series(vals)
    exp6 = s.rolling(6, min_periods=1).mean()
    exp_std = s.rolling(24, min_periods=1).std().fillna(0)
    exp_d24 = s.diff(24).fillna(0)
    assert (got.load_rolling_6h - exp6).abs().max() < 1e-9
    assert (got.load_std_24h - exp_std).abs().max() < 1e-9
    assert (got.load_diff_24h - exp_d24).abs().max() < 1e-9
    assert len(got) == n


def test_pct_change_zero_and_std_single(spark):
    vals = [1.0, 3.0, 0.0, 2.0, 0.0, 0.0]
    df = spark.createDataFrame([(1, i, v, 1.0, 0) for i, v in enumerate(vals)],
                               "site_id long, hidx long, total_load_kw double, grid_availability_ratio double, is_outage int")
    got = window_features(df).orderBy("hidx").collect()
    assert [r.load_pct_change_1h for r in got] == [0.0, 2.0, -1.0, 0.0, -1.0, 0.0]
    assert got[0].load_std_24h == 0.0


def test_percentile_interpolation(spark):
    from outagelens.operators.quantiles import exact_percentiles
    df = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 3.0, 10.0)], "g long, x double")
    r = exact_percentiles(df, ["g"], "x", [0.95]).collect()[0]
    assert abs(r.q0 - 8.95) < 1e-9


def test_round_half_up_portable(spark):
    r = spark.range(1).select(rnd(F.lit(1.005), 2).alias("a"), rnd(F.lit(2.5), 0).alias("b")).collect()[0]
    assert r.b == 3.0


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_grouped_fill_equals_per_column_fill(spark, block):
    vals = [None, 1.0, None, None, 4.0, None, None, 10.0, None]
    rows = [(1, i, v, None if v is None else 2 * v, None if v is None else int(v) % 2, w)
            for i, (v, w) in enumerate(zip(vals, [5.0, None, None, 7.0, None, None, None, None, 1.0]))]
    df = spark.createDataFrame(rows, "k long, i long, a double, b double, f int, w double")
    kw = dict(linear=["a", "b", "w"], carry=["f"], block=block)
    g = gap_fill(df, ["k"], "i", groups=[["a", "b", "f"]], **kw).orderBy("i").collect()
    u = gap_fill(df, ["k"], "i", **kw).orderBy("i").collect()
    assert [tuple(r) for r in g] == [tuple(r) for r in u]
    assert [r.a for r in g] == [1.0, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 10.0, 10.0]


def test_rounding_leaves_large_values_and_nan(spark):
    from outagelens.functions.numeric import rnd
    df = spark.createDataFrame([(1e14,), (float("nan"),), (None,), (float("-inf"),), (2.0000005,), (-1.2345675,)], "x double")
    got = [r[0] for r in df.select(rnd("x", 6)).collect()]
    assert got[0] == 1e14 and got[1] != got[1] and got[2] is None and got[3] == float("-inf")
    assert got[4] in (2.0, 2.000001) and abs(got[5] + 1.234567) < 1e-9


def test_last_rows_of_a_series_with_gaps(spark):
    from outagelens.operators.scoring import last_n_rows
    df = spark.range(100).selectExpr("1 as site_id", "id * 10 as hidx")
    got = sorted(r["hidx"] for r in last_n_rows(df, ["site_id"], "hidx", 72).collect())
    assert got == [i * 10 for i in range(28, 100)]


def test_each_column_is_filled_by_its_own_nulls(spark):
    from outagelens.operators.fill import gap_fill
    rows = [(1, 0, 1.0, None), (1, 1, None, None), (1, 2, 3.0, 5.0)]
    df = spark.createDataFrame(rows, "site_id int, hidx long, t double, h double")
    got = sorted((r["hidx"], r["t"], r["h"]) for r in gap_fill(df, ["site_id"], "hidx", ["t", "h"]).collect())
    assert got == [(0, 1.0, 5.0), (1, 2.0, 5.0), (2, 3.0, 5.0)]


def test_sites_without_history_or_profile_stay(spark):
    from outagelens.operators import scenarios as SC
    hist = spark.createDataFrame([(1, i, i % 24, 1, 100.0 + i) for i in range(48)], "site_id long, hidx long, hour int, month int, total_load_kw double")
    scen = spark.createDataFrame([(7, 1, 3, 1, 104.0), (8, 2, 3, 1, 10.0), (9, 3, 5, 2, 133.0)],
                                 "scenario_id long, site_id long, hour int, month int, total_load_kw double")
    prof = spark.createDataFrame([(2, 12.35)], "site_id long, avg_load_kw double")
    got = {r["scenario_id"]: r for r in SC.nearest_history(SC.with_lookup(scen, hist, prof), hist).collect()}
    mean = 100 + 47 / 2
    assert set(got) == {7, 8, 9} and got[7]["scale"] == 1.0 and got[7]["hidx"] == 3
    assert abs(got[8]["scale"] - 12.35 / mean) < 1e-12 and abs(got[9]["scale"] - 133 / mean) < 1e-12
    for s in (8, 9):
        want = {8: (3, 1, 10.0), 9: (5, 2, 133.0)}[s]
        best = min((3 * abs(i % 24 - want[0]) + abs(1 - want[1]) + abs((100 + i) * got[s]["scale"] - want[2]) / 30, i) for i in range(48))
        assert got[s]["hidx"] == best[1] and abs(got[s]["score"] - best[0]) < 1e-9
