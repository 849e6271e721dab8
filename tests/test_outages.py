"""Outage runs over block edges, storage size, balance and thresholds against plain Python."""

import random

import pytest

from outagelens.operators import metrics as M
from outagelens.operators import outages as O


def plain_runs(rows):
    out, now = [], None
    for s, i, f, v in sorted(rows):
        if f != 1:
            continue
        if now and now[0] == s and now[2] == i - 1:
            now[2], now[3], now[4], now[5] = i, now[3] + 1, now[4] + v, max(now[5], v)
        else:
            now = [s, i, i, 1, v, v]
            out.append(now)
    return sorted(tuple(r) for r in out)


@pytest.mark.parametrize("block", [1, 2, 5, 2048])
@pytest.mark.parametrize("rate", [0.1, 0.7, 1.0])
def test_runs_cross_block_edges(spark, block, rate):
    rng = random.Random(block)
    rows = [(s, i, int(rng.random() < rate), float(rng.randrange(100))) for s in (1, 2, 3) for i in range(-20, 40) if rng.random() < 0.95]
    df = spark.createDataFrame(rows, "site_id long, hidx long, f int, v double").repartition(4)
    got = O.runs(df, ["site_id"], "hidx", "f", {"total": "v"}, {"peak": "v"}, block=block)
    assert sorted(tuple(r) for r in got.collect()) == plain_runs(rows)


def test_no_outage_gives_no_run_and_no_size(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0, 1.0, 2.0)], "site_id long, hidx long, is_outage int, base_load_kw double, sterilization_kw double, total_load_kw double")
    assert O.storage_size(O.outage_runs(df)).collect() == []


def test_storage_carries_the_worst_run(spark):
    rows = [(1, i, int(i in (2, 3, 7)), 10.0, None, 8.0 if i == 7 else 30.0) for i in range(9)]
    df = spark.createDataFrame(rows, "site_id long, hidx long, is_outage int, base_load_kw double, sterilization_kw double, total_load_kw double")
    r = O.storage_size(O.outage_runs(df)).collect()[0]
    assert (r["n_runs"], r["longest_h"], r["outage_h"]) == (2, 2, 3)
    assert r["capacity_kwh"] == pytest.approx(24) and r["power_kw"] == pytest.approx(12)


def test_balance_has_all_subtotals(spark):
    df = spark.sql("""SELECT id % 2 AS site_id, TIMESTAMP_NTZ'2021-12-30' + make_dt_interval(0, id) AS hour_ts, 2.0D AS base_load_kw, 1.0D AS sterilization_kw,
        4.0D AS total_load_kw, 1.0D AS solar_pv_kw, CAST(NULL AS DOUBLE) AS generators_kw FROM range(96)""")
    rows = O.energy_balance(df).collect()
    top = [r for r in rows if r["level"] == 4]
    assert {r["category"]: (r["kwh"], r["share"]) for r in top} == {"vital": (288, 0.75), "comfort": (96, 0.25)}
    assert all(r["balance_kwh"] == -288 and r["site_id"] is None for r in top)
    assert sorted(sum(r["kwh"] for r in rows if r["level"] == k) for k in range(5)) == [384] * 5
    assert len({(r["site_id"], r["year"]) for r in rows if r["level"] == 2}) == 4


def test_best_threshold_against_all_thresholds(spark):
    rng = random.Random(4)
    rows = [(m, rng.randrange(2), rng.randrange(30) / 30) for m in "ab" for _ in range(200)] + [("c", 0, 0.5), ("c", 0, 0.7)]
    got = {r["model"]: r for r in M.best_threshold(spark.createDataFrame(rows, "model string, label int, score double")).collect()}
    for m in "abc":
        mine = [(y, s) for k, y, s in rows if k == m]
        best = max((2 * tp / (n + p) if n + p else 0.0, t) for t in {s for _, s in mine}
                   for tp, n, p in [(sum(y for y, s in mine if s >= t), sum(s >= t for _, s in mine), sum(y for y, _ in mine))])
        assert (got[m]["f1"], got[m]["threshold"]) == (pytest.approx(best[0]), best[1])
