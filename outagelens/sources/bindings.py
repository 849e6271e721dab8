"""Bindings of the driver tables to the engine's canonical schemas.

The engine works on site-level meter readings, weather readings, country facts
and a stage-change history.  These functions derive such tables from the
provided parquet tables with plain projections, so every query's work grows
with the input.  The mapping is fixed and documented here once:

* meter readings  <- ``events``: site_id = user_id; total_load_kw = value of every
  event; solar_pv_kw / base_load_kw / generators_kw / sterilization_kw = value of
  click / view / purchase / signup events; grid_available = 0 for error events.
* weather readings <- ``events`` of type view: temperature = value/2, humidity = k,
  wind = value, precipitation = k/5, pressure = 1000 + k/10, radiation = 10*value,
  where k is the integer in ``props``.
* stage history  <- ``orders``: created_at = o_orderdate, stage = first digit of
  o_orderpriority minus one.
* country facts  <- ``orders`` x ``customer``: per (nation, year) the share of
  status 'F' orders, in percent; area 'totl' for all orders, 'urb' for
  priority 1-2 orders.
* site profiles  <- ``customer`` x ``nation``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outagelens.sources.tables import read_table

METER_COLUMNS = ["solar_pv_kw", "total_load_kw", "generators_kw", "sterilization_kw", "base_load_kw"]
WEATHER_COLUMNS = [
    "temperature_2m", "relative_humidity_2m", "wind_speed_10m",
    "precipitation", "surface_pressure", "shortwave_radiation",
]


def meter_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["ts", "user_id", "event_type", "value"])
    v, et = F.col("value"), F.col("event_type")
    return ev.select(
        F.col("user_id").alias("site_id"),
        F.col("ts"),
        F.when(et == "click", v).alias("solar_pv_kw"),
        v.alias("total_load_kw"),
        F.when(et == "purchase", v).alias("generators_kw"),
        F.when(et == "signup", v).alias("sterilization_kw"),
        F.when(et == "view", v).alias("base_load_kw"),
        F.when(et == "error", F.lit(0)).otherwise(F.lit(1)).alias("grid_available"),
    ).withColumn("is_outage", (F.lit(1) - F.col("grid_available")).cast("int"))


def props_k(col: str = "props"):
    return F.get_json_object(F.col(col), "$.k").cast("double")


def weather_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    k = props_k()
    v = F.col("value")
    return ev.filter(F.col("event_type") == "view").select(
        F.col("user_id").alias("site_id"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
        (v / 2).alias("temperature_2m"),
        k.alias("relative_humidity_2m"),
        v.alias("wind_speed_10m"),
        (k / 5).alias("precipitation"),
        (F.lit(1000.0) + k / 10).alias("surface_pressure"),
        (v * 10).alias("shortwave_radiation"),
    )


def stage_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderdate", "o_orderpriority"])
    return o.select(
        F.col("o_orderdate").alias("created_at"),
        (F.substring("o_orderpriority", 1, 1).try_cast("int") - 1).alias("stage"),
    )


def country_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country_code, year, area_type, reliability_pct) facts; both areas from one aggregation."""
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    j = o.join(c, o.o_custkey == c.c_custkey)
    fin = (F.col("o_orderstatus") == "F").cast("double")
    urgent = F.substring("o_orderpriority", 1, 1).isin("1", "2")
    agg = j.groupBy(F.col("c_nationkey").alias("country_code"), F.year("o_orderdate").cast("int").alias("year")).agg(
        (F.avg(fin) * 100).alias("totl"), (F.avg(F.when(urgent, fin)) * 100).alias("urb"))
    areas = F.explode(F.array(F.struct(F.lit("totl").alias("a"), F.col("totl").alias("p")),
                              F.struct(F.lit("urb").alias("a"), F.col("urb").alias("p"))))
    return (agg.select("country_code", "year", areas.alias("x"))
            .select("country_code", "year", F.col("x.a").alias("area_type"), F.col("x.p").alias("reliability_pct"))
            .filter(F.col("reliability_pct").isNotNull()))


def site_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per site: country, reliability band inputs, avg load target, equipment flags, latitude."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return c.select(
        F.col("c_custkey").alias("site_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("country_code"),
        (F.abs(F.col("c_acctbal")) % 100).alias("who_reliability"),
        (F.abs(F.col("c_acctbal")) / 20 + 10).alias("avg_load_kw"),
        (F.col("c_mktsegment") != "AUTOMOBILE").alias("has_solar"),
        (F.col("c_mktsegment") != "BUILDING").alias("has_generator"),
        F.when(F.col("c_acctbal") < 1000, "faible").when(F.col("c_acctbal") < 5000, "moyen")
        .otherwise("stable").alias("grid_stability"),
        (F.col("c_acctbal") / 200).alias("lat"),
    )


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One what-if scenario per customer, aimed at the site with the same key (13 parameters)."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    k, a, n = F.col("c_custkey"), F.abs(F.col("c_acctbal")), F.col("c_nationkey")
    load = a / 10
    return c.select(
        k.alias("scenario_id"), k.alias("site_id"),
        (k % 24).cast("int").alias("hour"), (k % 12 + 1).cast("int").alias("month"),
        (k % 7).cast("int").alias("day_of_week"),
        load.alias("total_load_kw"),
        F.when(F.col("c_mktsegment") != "AUTOMOBILE", load * 0.3).otherwise(F.lit(0.0)).alias("solar_pv_kw"),
        (load * 0.85).alias("base_load_kw"), (load * 0.06).alias("sterilization_kw"),
        (F.lit(15.0) + n * 1.5).alias("temperature_2m"), (F.lit(40.0) + n * 2).alias("humidity"),
        (a % 120).alias("wind_speed"), (a % 37).alias("precipitation"), F.lit(1013.0).alias("pressure"),
        (a % 900).alias("radiation"),
    )
