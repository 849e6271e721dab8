"""Golden values hand-derivable from the reference's formulas and its published counts (FIXTURES.md)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from outagelens.operators import scoring as R
from outagelens.operators.context import add_reliability_context, stage_stats
from outagelens.operators.resample import hourly_grid


def test_stage_statistics_from_published_counts(spark):
    # stage counts 0..6 = 256/123/211/24/48/3/5 (670 events)
    counts = [256, 123, 211, 24, 48, 3, 5]
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), s) for i, s in
            enumerate(s for s, n in enumerate(counts) for _ in range(n))]
    df = spark.createDataFrame(rows, "created_at timestamp_ntz, stage int")
    r = stage_stats(df).collect()[0]
    assert (r.loadshed_avg_stage, r.loadshed_max_stage, r.loadshed_pct_active, r.n_events) == (1.27, 6, 0.6179, 670)


@pytest.mark.parametrize("rel, factor", [(50, 1.0), (45, 1.075), (54, 0.94), (23, 1.405), (20, 1.45),
                                         (98, 0.28), (99.5, 0.2575)])
def test_site_factor(spark, rel, factor):
    v = spark.range(1).select(R.site_factor(F.lit(float(rel))).alias("f")).collect()[0].f
    assert abs(v - factor) < 1e-12


def test_adjust_clips_and_notes(spark):
    adj = R.adjust_for_profile(F.lit(0.9), F.lit(20.0), F.lit("faible"), F.lit(False), F.lit(True))
    r = spark.range(1).select(adj["adjusted_probability"].alias("p"), adj["notes"].alias("n")).collect()[0]
    assert r.p == 0.99
    assert r.n == ["grid faible - very low reliability (20%)", "no solar panels"]


def test_missing_reliability_defaults_to_50(spark):
    sites = spark.createDataFrame([(1, 10), (2, 11)], "site_id long, country_code int")
    facts = spark.createDataFrame([(10, 2019, "totl", 70.0), (10, 2021, "totl", 80.0), (10, 2022, "urb", 10.0)],
                                  "country_code int, year int, area_type string, reliability_pct double")
    got = {r.site_id: r.who_reliability_pct for r in add_reliability_context(sites, facts).collect()}
    assert got == {1: 80.0, 2: 50.0}
    assert {r.who_reliability_pct for r in add_reliability_context(sites, None).collect()} == {50.0}


def test_resample_emits_empty_hours(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 15), 1.0), (1, dt.datetime(2024, 1, 1, 3, 0), 2.0)],
                               "site_id long, ts timestamp_ntz, total_load_kw double")
    g = hourly_grid(df, rules={"total_load_kw": "mean"}, renames={}).orderBy("hidx").collect()
    assert [r.total_load_kw for r in g] == [1.0, None, None, 2.0]
    assert g[0].hour_ts == dt.datetime(2024, 1, 1, 0, 0)


def test_first_alert_and_peak_ties(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, base + dt.timedelta(hours=i), p) for i, p in enumerate([0.2, 0.1, 0.1])] + \
           [(2, base + dt.timedelta(hours=i), p) for i, p in enumerate([0.2, 0.6, 0.7, 0.1])]
    df = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, p double")
    got = {r.site_id: r for r in R.first_alert(df, ["site_id"], "ts", "p").collect()}
    assert (got[1].has_alert, got[1].peak_probability, got[1].hours_away) == (False, 0.2, 2.0)
    assert (got[2].has_alert, got[2].peak_probability, got[2].hours_away) == (True, 0.6, 0.0)


def test_stress_rules(spark):
    row = spark.createDataFrame([(0.5, 130.0, 100.0, 90.0, 35.0, 40.0, 30.0)],
                                "p double, v_load double, total_load_kw_max double, total_load_kw_p95 double, "
                                "v_t double, temperature_2m_max double, temperature_2m_p95 double")
    st = R.extrapolation_stress("p", {"total_load_kw": F.col("v_load"), "temperature_2m": F.col("v_t")}, {})
    r = row.select(st["stress"].alias("s"), st["n_stressed"].alias("n"), st["stressed_probability"].alias("q")).collect()[0]
    # load: over max by 30 / max(10, 1) -> min(.25, .3) = .25; temp: over p95 by 5 / 10 -> min(.10, .025) = .025
    assert r.n == 2
    assert abs(r.s - (0.25 + 0.025) * 1.3) < 1e-12
    assert abs(r.q - min(0.99, 0.5 + (0.25 + 0.025) * 1.3)) < 1e-12


def test_csv_reader_rejects_html_saved_as_csv(spark, tmp_path):
    from pyspark.sql.types import DoubleType, StringType, StructType
    from outagelens.sources.tables import read_csv
    p = tmp_path / "broken.csv"
    p.write_text("datetime,total_load_kw\n<html><body>404 Not Found</body></html>\n")
    schema = StructType().add("datetime", StringType()).add("total_load_kw", DoubleType())
    with pytest.raises(Exception):
        read_csv(spark, str(p), schema).collect()
    good = tmp_path / "good.csv"
    good.write_text("datetime,total_load_kw\n2022-01-01 00:00:00,12.5\n")
    assert read_csv(spark, str(good), schema).collect()[0].total_load_kw == 12.5


def test_feature_reader_missing_table(spark, tmp_path):
    from outagelens.sources.tables import read_features
    with pytest.raises(FileNotFoundError):
        read_features(spark, str(tmp_path / "nope"))


def test_absent_input_defaults(spark):
    from outagelens.operators.features import feature_table
    df = spark.createDataFrame([(1, i, float(10 + i), 1, 0) for i in range(30)],
                               "site_id long, hidx long, total_load_kw double, grid_available int, is_outage int") \
        .withColumn("hour_ts", F.expr("timestampadd(HOUR, hidx, TIMESTAMP_NTZ'2024-01-01 00:00:00')"))
    ft = feature_table(df, absent_defaults=True)
    r = ft.orderBy("hidx").collect()[-1]
    assert (r.solar_ratio, r.generator_active, r.temperature_2m, r.grid_availability_rolling_6h) == (0.0, 0, 0.0, 1.0)
    assert "storm_risk" not in ft.columns
