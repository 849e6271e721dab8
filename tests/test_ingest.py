"""Raw tables with bad lines, tolerant ingest, and small parity helpers."""

import pytest
from pyspark.sql import functions as F

from outagelens.functions.numeric import rnd_even
from outagelens.operators import importance as IM
from outagelens.plans import manifest as MF
from outagelens.sources import raw


def meter_file(tmp_path, *lines, header=True):
    names = ",".join(h for h, _ in raw.METER_TABLE.columns)
    path = tmp_path / "meters.csv"
    path.write_text("\n".join(([names] if header else []) + list(lines)) + "\n")
    return str(path)


def test_lines_are_kept_or_quarantined_with_a_reason(spark, tmp_path):
    path = meter_file(tmp_path, "2022-01-01 00:00:00,1,2,3,4,5,1", "2022-01-01 00:15:00,,2,,4,5,0", "yesterday,1,2,3,4,5,1", ",1,2,3,4,5,1",
                      "2022-01-01 00:30:00,1,2kW,3,4,5,1", "2022-01-01 00:45:00,1,2,3,4,5", "2022-01-01 01:00:00,1,2,3,4,5,1,9", "31/12/2022 10:00,1,2,3,4,5,0")
    lines = raw.scan(spark, path, raw.METER_TABLE)
    assert {r["reason"]: r["n_lines"] for r in raw.report(lines).collect()} == {"ok": 3, "time": 2, "number:total_load_kw": 1, "columns": 2}
    good = sorted(raw.good_rows(lines, raw.METER_TABLE).collect())
    assert [str(r["datetime"]) for r in good] == ["2022-01-01 00:00:00", "2022-01-01 00:15:00", "2022-12-31 10:00:00"]
    assert [r["is_outage"] for r in good] == [0, 1, 1] and good[1]["solar_pv_kw"] is None and good[0]["total_load_kw"] == 2
    bad = raw.quarantine(lines, raw.METER_TABLE).collect()
    assert len(bad) == 5 and any(r["line"] == "2022-01-01 01:00:00,1,2,3,4,5,1,9" for r in bad)


def test_a_file_with_other_headers_fails(spark, tmp_path):
    path = meter_file(tmp_path, "<html>,a,b,c,d,e,f", "x,1,2,3,4,5,6", header=False)
    with pytest.raises(Exception, match="CSV header"):
        raw.scan(spark, path, raw.METER_TABLE).collect()


def test_day_first_and_month_first_are_a_choice_of_the_column(spark):
    df = spark.createDataFrame([("03/04/2022 00:00",)], "t string")
    both = [raw.fixed_order("dd/MM/yyyy HH:mm"), raw.fixed_order("MM/dd/yyyy HH:mm")]
    got = df.select(*(p(F.col("t")) for p in both)).first()
    assert [(t.month, t.day) for t in got] == [(4, 3), (3, 4)]


def test_a_broken_source_leaves_the_others(spark, tmp_path):
    path = meter_file(tmp_path, "2022-01-01 00:00:00,1,2,3,4,5,1")
    sources = [MF.Source("good", lambda: spark.range(3).toDF("x"), required=True), MF.Source("gone", lambda: spark.read.parquet(str(tmp_path / "no"))),
               MF.Source("broken", lambda: spark.range(1).select(F.raise_error(F.lit("boom")).cast("int").alias("x"))),
               MF.Source("none", lambda: spark.range(0).toDF("x")), MF.Source("csv", lambda: raw.good_rows(raw.scan(spark, path, raw.METER_TABLE), raw.METER_TABLE))]
    found = MF.ingest(sources)
    assert [(o.name, o.status, o.n_rows) for o in found.values()] == [
        ("good", "ok", 3), ("gone", "absent", 0), ("broken", "failed", 0), ("none", "empty", 0), ("csv", "ok", 1)]
    assert found["gone"].table is None and found["broken"].why
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        MF.ingest([MF.Source("gone", sources[1].load, required=True)])


def test_half_even_and_default_importances(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (0.25,)], "x double")
    assert [r[0] for r in df.select(rnd_even("x")).collect()] == [0, 2, 2, 0, 0]
    features = spark.createDataFrame([(c,) for c in "abcd"], "feature string")
    assert {r["importance"] for r in IM.reindex(None, features).collect()} == {0.25}
    some = spark.createDataFrame([("a", 2.0)], "feature string, importance double")
    assert {r["feature"]: r["importance"] for r in IM.reindex(some, features).collect()} == {"a": 2, "b": 0, "c": 0, "d": 0}


def test_bucketed_sink_reads_single_keys_from_their_folders(spark, tmp_path):
    from outagelens.sources import sinks
    df = spark.range(500).select((F.col("id") % 100).alias("site_id"), F.col("id").alias("v"))
    path = sinks.write_bucketed(df, str(tmp_path / "b"), "site_id", buckets=8)
    assert len(list((tmp_path / "b").glob("_bucket=*"))) <= 8
    assert sorted(map(tuple, sinks.read_bucketed(spark, path, "site_id").select("site_id", "v").collect())) == sorted(map(tuple, df.collect()))
    some = sinks.read_bucketed(spark, path, "site_id", [3, 77], buckets=8)
    assert sorted({r["site_id"] for r in some.collect()}) == [3, 77] and some.count() == 10
    assert "PartitionFilters: [" in some._jdf.queryExecution().toString() and "PartitionFilters: []" not in some._jdf.queryExecution().toString()
