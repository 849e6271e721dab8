"""The fill over spans: the same rows as on the dense grid, of which nothing is shuffled."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from outagelens import session
from outagelens.operators import blocked as B
from outagelens.operators import resample as RS
from outagelens.operators.fill import gap_fill

HOUR = "timestamp_ntz'2024-01-01 00:30:00' + make_dt_interval(0, cast(h as int))"
RULES = {"v": "mean", "w": "max"}


@pytest.fixture(scope="module")
def readings(spark):
    """Long gaps over several blocks, a value in a block's last rows, repeated hours, a null site, a null time, a site without any ``w``."""
    at = [("a", 0, 1.0, None), ("a", 5, None, 2), ("a", 6, 4.0, None), ("a", 41, 9.0, 7), ("a", 41, 10.0, 8), ("a", 90, None, None),
          ("b", 15, 3.0, None), ("b", 16, 5.0, None), ("c", 39, 2.0, 1), (None, 3, 1.0, 1), (None, 20, 2.0, 2)]
    d = spark.createDataFrame(at, "site_id string, h int, v double, w int").withColumn("ts", F.expr(HOUR))
    return d.unionAll(spark.createDataFrame([("c", 1.0, 1)], "site_id string, v double, w int").selectExpr(
        "site_id", "0 as h", "v", "w", "cast(null as timestamp_ntz) as ts")).drop("h")


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 3, "y"), (None, 4, "z")], "site_id string, n int, t string")


def dense(readings, sites):
    g = RS.hourly_grid(readings, rules=RULES, renames={}, block=8, site_columns=sites)
    return g.drop("hour_ts")


def sparse(readings, sites):
    spans = RS.hourly_spans(readings, site_columns=sites)
    return RS.known_hours(readings, spans, rules=RULES, renames={}), spans


@pytest.mark.parametrize("halo", [0, 3])
def test_fill_over_spans_equals_the_fill_of_the_grid(spark, readings, sites, halo):
    known, spans = sparse(readings, sites)
    want = gap_fill(dense(readings, sites), ["site_id"], "hidx", ["v"], ["w"], block=8, halo=halo)
    got = gap_fill(known, ["site_id"], "hidx", ["v"], ["w"], block=8, halo=halo, spans=spans)
    if halo:  # beyond a site's last block there is only a halo, which nobody asks for
        want, got = (B.drop_halo(d) for d in (want, got))
    assert set(got.columns) == set(want.columns) and got.count() == want.count() == 2 * 91 + 2 + 1 + 18
    assert got.exceptAll(want.select(got.columns)).count() == 0


def test_windows_see_the_halo(spark, readings, sites):
    from pyspark.sql import Window

    known, spans = sparse(readings, sites.dropDuplicates(["site_id"]))
    sums = lambda w: {"s": F.sum("v").over(w.rowsBetween(-3, 0))}
    got = B.blocked_rolling(gap_fill(known, ["site_id"], "hidx", ["v"], ["w"], block=8, halo=3, spans=spans), ["site_id"], "hidx", sums, halo=3, block=8)
    plain = gap_fill(known, ["site_id"], "hidx", ["v"], ["w"], block=8, spans=spans)
    want = plain.withColumns(sums(Window.partitionBy("site_id").orderBy("hidx")))
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).count() == 0


def test_more_rows_count_only_within_the_span(spark, readings):
    spans = RS.hourly_spans(readings)
    first = spans.where("site_id = 'b'").first()["_first"]
    more = spark.createDataFrame([("b", first - 1, 1.0), ("b", first + 1, 2.0), ("b", first + 2, 3.0), ("d", first, 4.0), (None, first, 5.0)],
                                 "site_id string, hidx long, x double")
    got = RS.known_hours(readings, spans, more, rules=RULES, renames={}).where("x is not null").collect()
    assert [(r["site_id"], r["hidx"], r["x"]) for r in got] == [("b", first + 1, 2.0)]


def test_the_feature_chain_shuffles_no_empty_hours(spark, tmp_path):
    from outagelens.plans import pipeline as P

    day = "timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(id as int) * 9)"
    spark.range(30).selectExpr("id as event_id", f"{day} as ts", "id % 3 as user_id", "elt(1 + id % 6, 'click', 'view', 'purchase', 'signup', "
                               "'error', 'view') as event_type", "cast(id * 7919 % 101 as double) as value", "'{\"k\": 40}' as props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(3).selectExpr("id as c_custkey", "int(id) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(9).selectExpr("id as o_orderkey", "id % 3 as o_custkey", "'F' as o_orderstatus", "date'2023-05-01' as o_orderdate",
                              "'1-URGENT' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    d = P.features(spark, str(tmp_path))
    lines = d._jdf.queryExecution().executedPlan().toString().splitlines()
    made = next(i for i, line in enumerate(lines) if "Generate explode(sequence(_from" in line)
    # plans are printed from the result down to the scans
    assert not [line for line in lines[:made] if "Exchange" in line]
    assert d.count() > 10 * 30


def test_methods_of_large_grids_stay_within_what_is_compiled(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = {n: spark.conf.get(n) for n in (name, "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes",
                                             "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set(name, "65535")
        session.room_for(spark, session.PARTITION_ROWS)
        assert spark.conf.get(name) == "65535"
        session.room_for(spark, session.PARTITION_ROWS + 1)
        assert spark.conf.get(name) == "8000"
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
