"""Queries on the feature table write only the columns they read, and make shared parts once."""

from __future__ import annotations

import os

import pytest

from outagelens import session
from outagelens.operators import linear as LIN
from outagelens.operators import profile as PR
from outagelens.operators import scenarios as SC
from outagelens.plans import catalogue
from outagelens.plans import pipeline as P


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    day = "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int) * 2)"
    spark.range(60).selectExpr("id as event_id", f"{day} as ts", "id % 3 as user_id", "elt(1 + id % 6, 'click', 'view', 'purchase', 'signup', "
                               "'error', 'view') as event_type", "cast(id * 7919 % 101 as double) as value", "'{\"k\": 40}' as props").write.parquet(f"{folder}/events.parquet")
    spark.range(4).selectExpr("id as c_custkey", "concat('c', id) as c_name", "int(id) as c_nationkey", "id * 1700.0D as c_acctbal",
                              "'BUILDING' as c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    spark.range(9).selectExpr("id as o_orderkey", "id % 3 as o_custkey", "'F' as o_orderstatus", "date'2023-05-01' as o_orderdate",
                              "'1-URGENT' as o_orderpriority").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


@pytest.mark.parametrize("name, cols", [("attribution_sink", list(LIN.RISK_WEIGHTS)), ("site_rescale", PR.RESCALED)])
def test_only_columns_that_are_read_are_written(spark, tables, name, cols):
    folder = session.checkpoint_dir(spark)
    before = set(os.listdir(folder))
    assert catalogue.queries()[name](spark, tables).count() > 0
    (written,) = [p for p in set(os.listdir(folder)) - before if p.startswith("outagelens-features-")]
    assert set(spark.read.parquet(f"{folder}/{written}").columns) == {"site_id", "hidx", *cols}


def test_scenario_delta_searches_the_history_once(spark, tables, monkeypatch):
    calls, search = [], SC.nearest_history
    monkeypatch.setattr(SC, "nearest_history", lambda *a, **k: calls.append(a) or search(*a, **k))
    rows = catalogue.queries()["scenario_delta"](spark, tables).orderBy("scenario_id").collect()
    assert len(calls) == 1
    assert [(r["scenario_id"], r["site_id"]) for r in rows] == [(k, k) for k in range(4)] and all(r["reference_probability"] for r in rows)


def test_top_factors_latest_makes_the_features_once(spark, tables, monkeypatch):
    calls, features = [], P.features
    monkeypatch.setattr(P, "features", lambda *a: calls.append(a) or features(*a))
    assert catalogue.queries()["top_factors_latest"](spark, tables).count() == 3 * 5
    assert len(calls) == 1
