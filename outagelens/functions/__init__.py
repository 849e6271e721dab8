from outagelens.functions.numeric import rnd, safe_ratio, clip01, flag, r6_sql, rnd_sql
from outagelens.functions.timefmt import hour_index, hour_ts_from_index, hour_floor, calendar_columns

__all__ = [
    "rnd", "safe_ratio", "clip01", "flag", "r6_sql", "rnd_sql",
    "hour_index", "hour_ts_from_index", "hour_floor", "calendar_columns",
]
