"""Independent SQL formulations (DuckDB dialect) of the catalogue queries.

They are written the plain way - whole-series windows per site, range joins,
``row_number() = 1`` picks - so they check the blocked/halo Spark plans from
another direction.  Doubles are rounded with the same half-up helper.
"""

from __future__ import annotations

from outagelens.functions.numeric import rnd_sql

POWER = ["solar_pv_kw", "total_load_kw", "generators_kw", "sterilization_kw", "base_load_kw"]
WEATHER = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m", "precipitation",
           "surface_pressure", "shortwave_radiation"]
HOUR_US = 3_600_000_000


def r6(e: str) -> str:
    return rnd_sql(e, 6)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


K = "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)"

READINGS = """readings AS (
  SELECT user_id AS site_id, ts,
    CASE WHEN event_type = 'click' THEN value END AS solar_pv_kw,
    value AS total_load_kw,
    CASE WHEN event_type = 'purchase' THEN value END AS generators_kw,
    CASE WHEN event_type = 'signup' THEN value END AS sterilization_kw,
    CASE WHEN event_type = 'view' THEN value END AS base_load_kw,
    CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS grid_available
  FROM events)"""

HOURLY = """hourly AS (
  SELECT site_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hidx,
    avg(solar_pv_kw) AS solar_pv_kw, avg(total_load_kw) AS total_load_kw,
    avg(generators_kw) AS generators_kw, avg(sterilization_kw) AS sterilization_kw,
    avg(base_load_kw) AS base_load_kw, avg(grid_available) AS grid_availability_ratio,
    CAST(max(1 - grid_available) AS INTEGER) AS is_outage
  FROM readings GROUP BY 1, 2)"""

HOUR_TS = "CAST(TIMESTAMP '1970-01-01 00:00:00' + to_hours({x}) AS TIMESTAMP)"

GRID = f"""bounds AS (SELECT site_id, min(hidx) AS lo, max(hidx) AS hi FROM hourly GROUP BY site_id),
spine AS (SELECT site_id, CAST(unnest(generate_series(lo, hi)) AS BIGINT) AS hidx FROM bounds),
grid AS (
  SELECT s.site_id, s.hidx, {HOUR_TS.format(x='s.hidx')} AS hour_ts,
    h.solar_pv_kw, h.total_load_kw, h.generators_kw, h.sterilization_kw, h.base_load_kw,
    h.grid_availability_ratio, h.is_outage
  FROM spine s LEFT JOIN hourly h ON s.site_id = h.site_id AND s.hidx = h.hidx)"""

WEATHER_CTE = f"""weather AS (
  SELECT user_id AS site_id, event_id AS seq, epoch_us(ts) AS rt,
    value / 2 AS temperature_2m, {K} AS relative_humidity_2m, value AS wind_speed_10m,
    {K} / 5 AS precipitation, 1000.0 + {K} / 10 AS surface_pressure, value * 10 AS shortwave_radiation
  FROM events WHERE event_type = 'view'),
wx_cand AS (
  SELECT g.site_id, g.hidx, {', '.join('w.' + c for c in WEATHER)},
    row_number() OVER (PARTITION BY g.site_id, g.hidx
      ORDER BY abs(w.rt - g.t), CASE WHEN w.rt > g.t THEN 1 ELSE 0 END,
               CASE WHEN w.rt > g.t THEN w.seq ELSE -w.seq END) AS rk
  FROM (SELECT site_id, hidx, hidx * {HOUR_US} AS t FROM grid) g
  JOIN weather w ON w.site_id = g.site_id AND w.rt BETWEEN g.t - {HOUR_US} AND g.t + {HOUR_US}),
wx AS (SELECT * EXCLUDE (rk) FROM wx_cand WHERE rk = 1)"""

FACTS = """facts AS (
  SELECT c.c_nationkey AS country_code, CAST(year(o.o_orderdate) AS INTEGER) AS year, 'totl' AS area_type,
    avg(CASE WHEN o.o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100 AS reliability_pct
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2
  UNION ALL
  SELECT c.c_nationkey, CAST(year(o.o_orderdate) AS INTEGER), 'urb',
    avg(CASE WHEN o.o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE substr(o.o_orderpriority, 1, 1) IN ('1', '2') GROUP BY 1, 2),
latest AS (SELECT country_code, arg_max(reliability_pct, year) AS who_reliability_pct, max(year) AS who_year
  FROM facts WHERE area_type = 'totl' GROUP BY 1)"""

STAGES = f"""stages AS (
  SELECT o_orderdate AS created_at, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS stage FROM orders),
sstats AS (
  SELECT {rnd_sql('avg(stage)', 2)} AS loadshed_avg_stage, CAST(max(stage) AS INTEGER) AS loadshed_max_stage,
    {rnd_sql('avg(CASE WHEN stage > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)', 4)} AS loadshed_pct_active,
    count(*) AS n_events, min(created_at) AS first_event, max(created_at) AS last_event
  FROM stages)"""


def fill_exprs(src_cols: list[str], linear: list[str], carry: list[str]) -> str:
    """Select list that fills columns by lerp/ffill/bfill over each site's whole series."""
    up = "OVER (PARTITION BY site_id ORDER BY hidx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    dn = "OVER (PARTITION BY site_id ORDER BY hidx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    parts = []
    for c in src_cols:
        if c in linear or c in carry:
            pi = f"last_value(CASE WHEN {c} IS NOT NULL THEN hidx END IGNORE NULLS) {up}"
            pv = f"last_value({c} IGNORE NULLS) {up}"
            ni = f"first_value(CASE WHEN {c} IS NOT NULL THEN hidx END IGNORE NULLS) {dn}"
            nv = f"first_value({c} IGNORE NULLS) {dn}"
            if c in linear:
                e = (f"COALESCE({c}, CASE WHEN ({pi}) IS NOT NULL AND ({ni}) IS NOT NULL AND ({ni}) <> ({pi}) "
                     f"THEN ({pv}) + (hidx - ({pi})) * (({nv}) - ({pv})) / (({ni}) - ({pi})) "
                     f"ELSE COALESCE({pv}, {nv}) END)")
            else:
                e = f"COALESCE({c}, {pv}, {nv})"
            parts.append(f"{e} AS {c}")
        else:
            parts.append(c)
    return ", ".join(parts)


GRID_COLS = ["site_id", "hidx", "hour_ts"] + POWER + ["grid_availability_ratio", "is_outage"]

FILLED = ("filled AS (SELECT " + fill_exprs(GRID_COLS, POWER + ["grid_availability_ratio"], ["is_outage"])
          + " FROM grid)")

MERGED_COLS = (["site_id", "country_code", "hidx", "hour_ts"] + POWER + ["grid_availability_ratio", "is_outage"]
               + WEATHER + ["who_reliability_pct", "loadshed_avg_stage", "loadshed_max_stage",
                            "loadshed_pct_active", "hour", "day_of_week", "month"])

MERGED0 = f"""merged0 AS (
  SELECT g.site_id, cu.c_nationkey AS country_code, g.hidx, g.hour_ts,
    {', '.join('g.' + c for c in POWER)}, g.grid_availability_ratio, g.is_outage,
    {', '.join('wx.' + c for c in WEATHER)},
    COALESCE(la.who_reliability_pct, 50.0) AS who_reliability_pct,
    ss.loadshed_avg_stage, ss.loadshed_max_stage, ss.loadshed_pct_active,
    CAST(hour(g.hour_ts) AS INTEGER) AS hour, CAST(isodow(g.hour_ts) - 1 AS INTEGER) AS day_of_week,
    CAST(month(g.hour_ts) AS INTEGER) AS month
  FROM grid g
  LEFT JOIN wx ON wx.site_id = g.site_id AND wx.hidx = g.hidx
  LEFT JOIN customer cu ON cu.c_custkey = g.site_id
  LEFT JOIN latest la ON la.country_code = cu.c_nationkey
  CROSS JOIN sstats ss)"""

MERGED = ("merged AS (SELECT " + fill_exprs(MERGED_COLS, POWER + ["grid_availability_ratio"] + WEATHER,
                                           ["is_outage"]) + " FROM merged0)")

MERGED_CHAIN = [READINGS, HOURLY, GRID, WEATHER_CTE, FACTS, STAGES, MERGED0, MERGED]
FILLED_CHAIN = [READINGS, HOURLY, GRID, FILLED]

W = "PARTITION BY site_id ORDER BY hidx"


def ordered_avg(c: str, back: int) -> str:
    """Mean over the last ``back+1`` rows, summed oldest to newest (the order Spark's row frame uses)."""
    frame = f"OVER ({W} ROWS BETWEEN {back} PRECEDING AND CURRENT ROW)"
    return f"(list_reduce(list({c}) {frame}, lambda a, b: a + b) / count({c}) {frame})"


def load_feature_exprs() -> dict[str, str]:
    c = "total_load_kw"
    lag1 = f"lag({c}, 1) OVER ({W})"
    roll24 = ordered_avg(c, 23)
    return {
        "load_rolling_6h": ordered_avg(c, 5),
        "load_rolling_24h": roll24,
        "load_std_24h": f"COALESCE(stddev_samp({c}) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 0)",
        "load_diff_1h": f"COALESCE({c} - {lag1}, 0)",
        "load_diff_24h": f"COALESCE({c} - lag({c}, 24) OVER ({W}), 0)",
        "load_pct_change_1h": f"COALESCE(({c} - {lag1}) / NULLIF({lag1}, 0), 0)",
        "peak_ratio": f"COALESCE({c} / NULLIF({roll24}, 0), 1)",
    }


def history_exprs() -> dict[str, str]:
    return {
        "grid_availability_rolling_6h": ordered_avg("grid_availability_ratio", 5),
        "recent_outages_6h": f"sum(CAST(is_outage AS DOUBLE)) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)",
        "recent_outages_24h": f"sum(CAST(is_outage AS DOUBLE)) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)",
    }


def ratio(num: str) -> str:
    return f"LEAST(GREATEST(COALESCE({num} / NULLIF(total_load_kw, 0), 0), 0), 1)"


def flag(cond: str) -> str:
    return f"CAST(COALESCE({cond}, false) AS INTEGER)"


def source_exprs() -> dict[str, str]:
    return {
        "solar_ratio": ratio("solar_pv_kw"),
        "generator_active": flag("generators_kw > 1.0"),
        "generator_ratio": ratio("generators_kw"),
        "base_load_ratio": ratio("base_load_kw"),
    }


def cyclic_exprs() -> dict[str, str]:
    return {
        "is_weekend": "CAST(day_of_week >= 5 AS INTEGER)",
        "hour_sin": "sin(2 * pi() * hour / 24)",
        "hour_cos": "cos(2 * pi() * hour / 24)",
        "month_sin": "sin(2 * pi() * month / 12)",
        "month_cos": "cos(2 * pi() * month / 12)",
    }


def weather_exprs() -> dict[str, str]:
    return {
        "temp_humidity_interaction": "temperature_2m * relative_humidity_2m / 100",
        "wind_precipitation_interaction": "wind_speed_10m * precipitation",
        "solar_available": flag("shortwave_radiation > 50"),
        "heat_stress": flag("temperature_2m > 30"),
        "storm_risk": "CAST((COALESCE(wind_speed_10m > 40, false) OR COALESCE(precipitation > 10, false)) AS INTEGER)",
    }


FEATURE_TYPES_INT = {"is_outage", "loadshed_max_stage", "hour", "day_of_week", "month", "is_weekend",
                     "generator_active", "solar_available", "heat_stress", "storm_risk", "country_code"}


def _derived() -> dict[str, str]:
    derived = {}
    derived.update(cyclic_exprs())
    derived.update(load_feature_exprs())
    derived.update(history_exprs())
    derived.update(source_exprs())
    derived.update(weather_exprs())
    derived["reliability_risk"] = "1 - who_reliability_pct / 100"
    return derived


FEATURE_COLS = MERGED_COLS + list(_derived())


def _feature_ctes() -> list[str]:
    derived = _derived()
    feat = "feat AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in derived.items()) + " FROM merged)"
    sel = []
    for c in FEATURE_COLS:
        if c in ("site_id", "hidx", "hour_ts"):
            sel.append(c)
        elif c in FEATURE_TYPES_INT:
            sel.append(f"CAST(COALESCE({c}, 0) AS INTEGER) AS {c}")
        else:
            sel.append(f"CAST(COALESCE({c}, 0) AS DOUBLE) AS {c}")
    return [feat, "ft AS (SELECT " + ", ".join(sel) + " FROM feat)"]


FEATURE_CHAIN = MERGED_CHAIN + _feature_ctes()


def feature_table_sql() -> str:
    """Full feature table: merged + derived, every numeric null -> 0, doubles rounded."""
    return with_(*FEATURE_CHAIN) + select_rounded(FEATURE_COLS, "ft", ints=FEATURE_TYPES_INT,
                                                  keep=("site_id", "hidx", "hour_ts"))


def select_rounded(cols: list[str], src: str, ints: set[str] = frozenset(), keep: tuple = ()) -> str:
    sel = []
    for c in cols:
        if c in keep:
            sel.append(c)
        elif c in ints:
            sel.append(f"CAST({c} AS INTEGER) AS {c}")
        else:
            sel.append(f"{r6(c)} AS {c}")
    return "SELECT " + ", ".join(sel) + f" FROM {src}"


def percentile_ctes(name: str, src: str, groups: list[str], values: list[str], q: float) -> list[str]:
    """Exact interpolated percentile per group and value column, from ranks:
    x[floor(h)] + (x[ceil(h)] - x[floor(h)]) * (h - floor(h)), h = (n - 1) q; output columns ``<v>_pNN``."""
    g = ", ".join(groups)
    qd = f"CAST({q!r} AS DOUBLE)"
    longs = " UNION ALL ".join(f"SELECT {g}, '{v}' AS feature, CAST({v} AS DOUBLE) AS v FROM {src} WHERE {v} IS NOT NULL"
                               for v in values)
    tag = f"p{int(round(q * 100)):02d}"
    piv = ", ".join(f"max(CASE WHEN feature = '{v}' THEN qv END) AS {v}_{tag}" for v in values)
    return [
        f"{name}_long AS ({longs})",
        f"""{name}_rk AS (SELECT {g}, feature, v, row_number() OVER (PARTITION BY {g}, feature ORDER BY v) - 1 AS r,
  count(*) OVER (PARTITION BY {g}, feature) AS n FROM {name}_long)""",
        f"""{name}_pq AS (SELECT {g}, feature,
  max(CASE WHEN r = floor((n - 1) * {qd}) THEN v END) AS xlo, max(CASE WHEN r = ceil((n - 1) * {qd}) THEN v END) AS xhi,
  max((n - 1) * {qd}) AS h FROM {name}_rk GROUP BY {g}, feature)""",
        f"""{name} AS (SELECT {g}, {piv} FROM (SELECT {g}, feature, xlo + (xhi - xlo) * (h - floor(h)) AS qv FROM {name}_pq)
  GROUP BY {g})""",
    ]
