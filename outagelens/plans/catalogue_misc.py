"""Text, JSON, sink, profile, schema, positional and attribution queries with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from outagelens.functions import text as TX
from outagelens.functions.numeric import rnd_sql
from outagelens.operators import align as AL
from outagelens.operators import profile as PR
from outagelens.operators import scoring as R
from outagelens.operators.context import positional_zip
from outagelens.plans import oracle_sql as S
from outagelens.plans import pipeline as P
from outagelens.plans.registry import out, register
from outagelens.session import materialised
from outagelens.sources import bindings, json_flatten as JF, sinks
from outagelens.sources.tables import read_table


def r6(e):
    return rnd_sql(e, 6)


# ---------------------------------------------------------------- text

KEEP = ["datetime_str", "p_partkey", "p_size", "p_retailprice", "p_type", "not_present"]


@register("coerce_numeric", """SELECT p_name AS datetime_str, TRY_CAST(CAST(p_partkey AS VARCHAR) AS DOUBLE) AS p_partkey,
  TRY_CAST(CAST(p_size AS VARCHAR) AS DOUBLE) AS p_size, TRY_CAST(CAST(p_retailprice AS VARCHAR) AS DOUBLE) AS p_retailprice,
  TRY_CAST(p_type AS DOUBLE) AS p_type FROM part""")
def q_coerce_numeric(spark, sf_dir):
    part = read_table(spark, sf_dir, "part", ["p_name", "p_partkey", "p_size", "p_retailprice", "p_type"])
    raw = part.select(*[F.col(c).cast("string").alias(c) for c in part.columns])  # text as read from a CSV
    d = TX.keep_present(TX.rename_first(raw, "datetime_str"), KEEP)
    return TX.coerce_numeric(d, ["p_partkey", "p_size", "p_retailprice", "p_type"])


@register("normalise_code", """SELECT p_partkey, lower(replace(p_brand, 'Brand#', '')) AS brand_code, lower(p_type) AS type_code,
  lower(replace('RESIDENCEAREATYPE_' || p_type, 'RESIDENCEAREATYPE_', '')) AS area_type FROM part""")
def q_normalise_code(spark, sf_dir):
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type"])
    return part.select("p_partkey", TX.strip_prefix_lower(F.col("p_brand"), "Brand#").alias("brand_code"),
                       F.lower("p_type").alias("type_code"),
                       JF.clean_area(F.concat(F.lit(JF.AREA_PREFIX), F.col("p_type"))).alias("area_type"))


def _yearless_text_sql() -> str:
    hh = "CASE WHEN hour(ts) = 0 THEN '24' WHEN event_id % 2 = 1 THEN CAST(hour(ts) AS VARCHAR) ELSE lpad(CAST(hour(ts) AS VARCHAR), 2, '0') END"
    return ("' ' || lpad(CAST(month(ts) AS VARCHAR), 2, '0') || '/' || lpad(CAST(day(ts) AS VARCHAR), 2, '0') || '  ' || "
            + hh + " || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(second(ts)) AS INTEGER) AS VARCHAR), 2, '0') || ' '")


@register("parse_yearless_ts", f"""SELECT event_id, raw_text, try_strptime('2022/' || trim(raw_text), '%Y/%m/%d  %H:%M:%S') AS parsed
FROM (SELECT event_id, {_yearless_text_sql()} AS raw_text FROM events)""")
def q_parse_yearless(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts"])
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    hh = F.when(F.hour("ts") == 0, F.lit("24")).when(F.col("event_id") % 2 == 1, F.hour("ts").cast("string")) \
        .otherwise(pad(F.hour("ts")))
    raw = F.concat(F.lit(" "), pad(F.month("ts")), F.lit("/"), pad(F.dayofmonth("ts")), F.lit("  "), hh, F.lit(":"),
                   pad(F.minute("ts")), F.lit(":"), pad(F.floor(F.second("ts"))), F.lit(" "))
    d = ev.select("event_id", raw.alias("raw_text"))
    return d.withColumn("parsed", TX.parse_yearless(F.col("raw_text"), 2022))


# ---------------------------------------------------------------- JSON

RECORD_SCHEMA = (StructType().add("SpatialDim", StringType()).add("TimeDim", IntegerType()).add("Dim1", StringType())
                 .add("NumericValue", DoubleType()).add("ParentLocationCode", StringType())
                 .add("ParentLocation", StringType()).add("Comments", StringType()))
REC_OUT = ["event_id", "country_code", "year", "area_type", "reliability_pct", "region_code", "region"]


@register("json_records_flatten", """SELECT event_id, CAST(user_id AS VARCHAR) AS country_code, CAST(year(ts) AS INTEGER) AS year,
  lower(event_type) AS area_type, value AS reliability_pct, CAST(user_id % 5 AS VARCHAR) AS region_code,
  'R' || CAST(user_id % 5 AS VARCHAR) AS region FROM events""")
def q_json_records(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    rec = F.struct(F.col("user_id").cast("string").alias("SpatialDim"), F.year("ts").alias("TimeDim"),
                   F.concat(F.lit(JF.AREA_PREFIX), F.upper("event_type")).alias("Dim1"),
                   F.col("value").alias("NumericValue"), (F.col("user_id") % 5).cast("string").alias("ParentLocationCode"),
                   F.concat(F.lit("R"), (F.col("user_id") % 5).cast("string")).alias("ParentLocation"),
                   F.lit("api payload").alias("Comments"))
    docs = ev.select("event_id", F.to_json(F.struct(F.array(rec).alias("value"))).alias("doc"))
    rows = JF.records_to_rows(docs, "doc", RECORD_SCHEMA, keep=list(JF.RECORD_FIELDS), carry=["event_id"])
    rows = JF.rename(rows, JF.RECORD_FIELDS).withColumn("area_type", JF.clean_area(F.col("area_type")))
    return rows.select(*REC_OUT)


ARRAYS_SCHEMA = (StructType().add("time", ArrayType(StringType())).add("temperature_2m", ArrayType(DoubleType()))
                 .add("relative_humidity_2m", ArrayType(DoubleType())))


@register("json_arrays_flatten", f"""SELECT event_id, CAST(date_trunc('minute', ts + to_hours(i)) AS TIMESTAMP) AS time,
  value / CAST(pow(2, i) AS DOUBLE) AS temperature_2m, {S.K} + i AS relative_humidity_2m
FROM events CROSS JOIN (SELECT CAST(unnest(range(3)) AS BIGINT) AS i)""")
def q_json_arrays(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "value", "props"])
    k = bindings.props_k()
    t = lambda i: F.date_format(F.timestamp_add("HOUR", F.lit(i), F.col("ts")), "yyyy-MM-dd'T'HH:mm")
    doc = F.to_json(F.struct(F.struct(
        F.array(t(0), t(1), t(2)).alias("time"),
        F.array(F.col("value"), F.col("value") / 2, F.col("value") / 4).alias("temperature_2m"),
        F.array(k, k + 1, k + 2).alias("relative_humidity_2m")).alias("hourly")))
    rows = JF.arrays_to_rows(ev.select("event_id", doc.alias("doc")), "doc", ARRAYS_SCHEMA, carry=["event_id"])
    return rows.withColumn("time", F.to_timestamp_ntz(F.col("time"), F.lit("yyyy-MM-dd'T'HH:mm")))


# ---------------------------------------------------------------- sinks

@register("sink_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_sink_roundtrip(spark, sf_dir):
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    path = sinks.write_partitioned(nation, sinks.shared_path(spark, "nation_by_region"), ["n_regionkey"])
    back = spark.read.parquet(path)
    return back.select("n_nationkey", "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


def _summary_sql() -> str:
    from outagelens.plans.registry import REGISTRY
    cmp_sql = REGISTRY["model_compare"][1]
    return f"SELECT model, f1, rank FROM ({cmp_sql}) c"


@register("summary_json_roundtrip", _summary_sql())
def q_summary_json(spark, sf_dir):
    """Nested run summary written as JSON, one key read back with get_json_object."""
    from outagelens.operators import metrics as M
    from outagelens.sources.scored import scored_lines
    cmp = M.model_compare(scored_lines(spark, sf_dir))
    summ = cmp.select(F.struct("model", F.struct("accuracy", "precision", "recall", "f1", "roc_auc", "brier")
                               .alias("test_metrics"), "rank").alias("s")).select("s.*")
    path = sinks.write_json(summ, sinks.shared_path(spark, "training_summary"))
    txt = spark.read.text(path)
    return txt.select(F.get_json_object("value", "$.model").alias("model"),
                      F.get_json_object("value", "$.test_metrics.f1").cast("double").alias("f1"),
                      F.get_json_object("value", "$.rank").cast("int").alias("rank"))


# ---------------------------------------------------------------- profiles

SUPP_SQL = """supp AS (
  SELECT s.s_suppkey, CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS annual_kwh,
    CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18, 2)) * CAST(l.l_discount AS DECIMAL(4, 2))) AS DOUBLE) AS cost,
    abs(s.s_acctbal) + 1000 AS floor_area_m2, s.s_acctbal > 0 AS has_solar
  FROM supplier s JOIN lineitem l ON l.l_suppkey = s.s_suppkey GROUP BY s.s_suppkey, s.s_acctbal)"""


def supplier_sites(spark, sf_dir):
    """Annual totals per supplier (exact decimal sums; partial aggregation before the shuffle)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_extendedprice", "l_discount"])
    su = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_acctbal"])
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    tot = li.groupBy("l_suppkey").agg(F.sum(price).cast("double").alias("annual_kwh"),
                                      F.sum(price * F.col("l_discount").cast("decimal(4,2)")).cast("double").alias("cost"))
    return su.join(tot, su.s_suppkey == tot.l_suppkey).select(
        "s_suppkey", "annual_kwh", "cost", (F.abs("s_acctbal") + 1000).alias("floor_area_m2"),
        (F.col("s_acctbal") > 0).alias("has_solar"))


@register("site_intensity", "WITH " + SUPP_SQL + f"""
SELECT s_suppkey, annual_kwh, {rnd_sql('annual_kwh / 8760', 0)} AS avg_hourly_kw,
  {rnd_sql('annual_kwh / floor_area_m2', 1)} AS electricity_intensity_kwh_m2,
  {rnd_sql('cost / NULLIF(annual_kwh, 0)', 4)} AS electricity_cost_per_kwh, {r6('annual_kwh / 1e6')} AS annual_gwh
FROM supp""")
def q_site_intensity(spark, sf_dir):
    d = PR.intensity(supplier_sites(spark, sf_dir), "annual_kwh", "floor_area_m2", "cost")
    return out(d, ["s_suppkey", "annual_kwh", "avg_hourly_kw", "electricity_intensity_kwh_m2",
                   "electricity_cost_per_kwh", "annual_gwh"])


def _profile_sql() -> str:
    mean = "(annual_kwh / 8760)"
    h, m = "CAST(hour(datetime) AS DOUBLE)", "CAST(month(datetime) AS DOUBLE)"
    daily = (f"CASE WHEN hour(datetime) BETWEEN 7 AND 20 THEN 0.85 + 0.15 * sin(pi() * ({h} - 7) / 13) "
             f"ELSE 0.6 + 0.1 * sin(pi() * {h} / 24) END")
    seasonal = f"(1.0 + 0.15 * cos(2 * pi() * ({m} - 1) / 12))"
    weekend = "CASE WHEN isodow(datetime) >= 6 THEN 0.82 ELSE 1.0 END"
    load = f"greatest({mean} * ({daily}) * {seasonal} * {weekend}, {mean} * 0.3)"
    sun = f"greatest(sin(pi() * ({h} - 6) / 12), 0.0)"
    month_sun = f"(0.6 + 0.4 * greatest(sin(pi() * ({m} - 3) / 6), 0.0))"
    solar = f"CASE WHEN COALESCE(has_solar, false) THEN {mean} * 0.15 * {sun} * 0.65 * {month_sun} ELSE 0.0 END"
    steril = f"CASE WHEN hour(datetime) BETWEEN 8 AND 17 THEN {mean} * 0.06 ELSE 0.0 END"
    return f"""prof_h AS (
  SELECT s_suppkey, CAST(h AS INTEGER) AS h_of_year, CAST(TIMESTAMP '2022-01-01 00:00:00' + to_hours(h) AS TIMESTAMP) AS datetime,
    annual_kwh, has_solar FROM supp CROSS JOIN (SELECT unnest(range(8760)) AS h)),
prof AS (
  SELECT s_suppkey, h_of_year, datetime, {rnd_sql(load, 1)} AS total_load_kw, {rnd_sql(solar, 1)} AS solar_pv_kw,
    {rnd_sql(f'({load}) * 0.65', 1)} AS base_load_kw, {rnd_sql(steril, 1)} AS sterilization_kw,
    CAST(month(datetime) AS INTEGER) AS month, {load} AS load_raw
  FROM prof_h)"""


PROFILE_COLS = ["s_suppkey", "h_of_year", "datetime", "total_load_kw", "solar_pv_kw", "base_load_kw",
                "sterilization_kw", "month"]


def _profiles(spark, sf_dir):
    return PR.hourly_profile(supplier_sites(spark, sf_dir), "s_suppkey", "annual_kwh", "has_solar")


@register("profile_expand", "WITH " + SUPP_SQL + ",\n" + _profile_sql() + "\nSELECT * EXCLUDE (load_raw) FROM prof")
def q_profile_expand(spark, sf_dir):
    return out(_profiles(spark, sf_dir), PROFILE_COLS)


@register("peak_season_risk", S.with_(SUPP_SQL, _profile_sql(),
                                      *S.percentile_ctes("p90", "prof", ["s_suppkey"], ["load_raw"], 0.9)) + f"""
SELECT p.s_suppkey, {r6('max(q.load_raw_p90)')} AS load_p90,
  count(*) FILTER (WHERE p.load_raw > q.load_raw_p90) AS n_peak_hours,
  count(*) FILTER (WHERE p.month IN (11, 12, 1, 2)) AS n_winter_hours,
  {r6(f"sum({(100.0 - 99.5) / 100.0 / 365.0 * 12.0!r} * CASE WHEN p.load_raw > q.load_raw_p90 THEN 2.5 ELSE 1.0 END * CASE WHEN p.month IN (11, 12, 1, 2) THEN 1.8 ELSE 1.0 END)")} AS expected_outages
FROM prof p JOIN p90 q ON q.s_suppkey = p.s_suppkey GROUP BY p.s_suppkey""")
def q_peak_season_risk(spark, sf_dir):
    prof = materialised(_profiles(spark, sf_dir), "profiles")
    return out(PR.peak_season_risk(prof, "s_suppkey"),
               ["s_suppkey", "load_p90", "n_peak_hours", "n_winter_hours", "expected_outages"])


RESCALE_OUT = ["site_id", "hidx"] + PR.RESCALED + ["solar_ratio", "base_load_ratio", "peak_ratio"]


@register("site_rescale", S.with_(*S.FEATURE_CHAIN) + """,
prof2 AS (SELECT c_custkey AS site_id, abs(c_acctbal) / 20 + 10 AS avg_load_kw, c_mktsegment <> 'AUTOMOBILE' AS has_solar FROM customer),
sc AS (SELECT a.site_id, COALESCE(p.avg_load_kw, 133.0) / greatest(a.obs, 1.0) AS scale, p.has_solar
  FROM (SELECT site_id, avg(total_load_kw) AS obs FROM ft GROUP BY site_id) a LEFT JOIN prof2 p ON p.site_id = a.site_id),
rs AS (SELECT f.site_id, f.hidx, """ + ", ".join(
    f"f.{c} * sc.scale AS {c}" if c != "solar_pv_kw" else
    "CASE WHEN COALESCE(sc.has_solar, true) THEN f.solar_pv_kw * sc.scale ELSE 0.0 END AS solar_pv_kw"
    for c in PR.RESCALED) + """ FROM ft f JOIN sc ON sc.site_id = f.site_id)
SELECT site_id, hidx, """ + ", ".join(f"{r6(c)} AS {c}" for c in PR.RESCALED) + ", " + r6(S.ratio("solar_pv_kw")) + " AS solar_ratio, " + r6(S.ratio("base_load_kw")) + """ AS base_load_ratio,
  """ + r6("COALESCE(total_load_kw / NULLIF(load_rolling_24h, 0), 1)") + " AS peak_ratio FROM rs")
def q_site_rescale(spark, sf_dir):
    feats = materialised(P.features(spark, sf_dir).select("site_id", "hidx", *PR.RESCALED), "features")
    d = PR.site_rescale(feats, bindings.site_profiles(spark, sf_dir))
    return out(d, RESCALE_OUT)


# ---------------------------------------------------------------- schema helpers


def _feature_matrix_cols() -> list[str]:
    return [c for c in S.FEATURE_COLS if c not in AL.EXCLUDED and c not in AL.ID_COLUMNS]


FM_INTS = S.FEATURE_TYPES_INT | {"label"}


@register("feature_matrix", S.with_(*S.FEATURE_CHAIN) + S.select_rounded(
    ["site_id", "hidx"] + _feature_matrix_cols() + ["label"],
    "(SELECT *, CAST(is_outage AS INTEGER) AS label FROM ft)", ints=FM_INTS, keep=("site_id", "hidx")))
def q_feature_matrix(spark, sf_dir):
    fm = AL.feature_matrix(P.features(spark, sf_dir))
    return out(fm, fm.columns)


@register("align_schema", S.with_(*S.FILLED_CHAIN) + "SELECT site_id, hidx, " + ", ".join(
    (r6(c) if c in S.GRID_COLS else "CAST(0.0 AS DOUBLE)") + f" AS {c}" for c in _feature_matrix_cols()) + " FROM filled")
def q_align_schema(spark, sf_dir):
    cols = AL.feature_columns(P.features(spark, sf_dir))  # for its schema: the features themselves are not made
    return out(AL.align_schema(P.filled_grid(spark, sf_dir), cols, keys=["site_id", "hidx"]),
               ["site_id", "hidx", *cols])


AUDIT_COLS = S.GRID_COLS


@register("null_audit", S.with_(S.READINGS, S.HOURLY, S.GRID) + "SELECT count(*) AS n_rows, " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS nulls_{c}" for c in AUDIT_COLS) + ", CAST(" + " + ".join(
    f"count(*) FILTER (WHERE {c} IS NULL)" for c in AUDIT_COLS) + " AS BIGINT) AS nulls_total FROM grid")
def q_null_audit(spark, sf_dir):
    return AL.null_audit(P.site_grid(spark, sf_dir), AUDIT_COLS)


# ---------------------------------------------------------------- positional zip

@register("positional_zip", """WITH l AS (SELECT user_id AS site_id, event_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id AS site_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
    FROM events WHERE event_type = 'view'),
lat AS (SELECT c_custkey AS site_id, c_acctbal / 200 AS lat FROM customer)
SELECT l.site_id, l.pos, l.event_id, """ + r6("r.value / 2 - (51.5 - lat.lat) * 0.15") + """ AS temperature_2m
FROM l LEFT JOIN r ON r.site_id = l.site_id AND r.pos = l.pos LEFT JOIN lat ON lat.site_id = l.site_id""")
def q_positional_zip(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"]) \
        .withColumnRenamed("user_id", "site_id")
    left = ev.filter(F.col("event_type") == "purchase").select("site_id", "ts", "event_id")
    right = ev.filter(F.col("event_type") == "view").select("site_id", "ts", "event_id", "value")
    z = positional_zip(left, right, ["site_id"], ["ts", "event_id"], ["ts", "event_id"], ["value"])
    lat = bindings.site_profiles(spark, sf_dir).select("site_id", "lat")
    z = z.join(lat, "site_id", "left")
    z = z.withColumn("temperature_2m", F.col("value") / 2 - (F.lit(51.5) - F.col("lat")) * 0.15)
    return out(z, ["site_id", "pos", "event_id", "temperature_2m"])


# ---------------------------------------------------------------- streaming (extension)

@register("streaming_resample", S.with_(S.READINGS, S.HOURLY) + """
SELECT site_id, hidx, """ + ", ".join(f"{r6(c)} AS {c}" for c in S.POWER + ["grid_availability_ratio"]) + """, is_outage
FROM hourly""")
def q_streaming_resample(spark, sf_dir):
    from outagelens.streaming.resample_stream import run_available_now
    d = run_available_now(spark, sf_dir)
    return out(d, ["site_id", "hidx", *S.POWER, "grid_availability_ratio", "is_outage"])
