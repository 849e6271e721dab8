"""Timezone-independent calendar arithmetic on ``timestamp_ntz`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_MICROS_PER_HOUR = 3_600_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_index(ts: Column | str) -> Column:
    """Microseconds since the epoch, computed without the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), _col(ts))


def hour_index(ts: Column | str) -> Column:
    """Whole hours since the epoch: a dense row index on an hourly grid."""
    return F.floor(micros_index(ts) / F.lit(_MICROS_PER_HOUR)).cast("long")


def hour_ts_from_index(idx: Column | str) -> Column:
    return F.timestamp_add("HOUR", _col(idx), F.expr(_EPOCH))


def hour_floor(ts: Column | str) -> Column:
    """The hour a timestamp falls in, as ``timestamp_ntz`` (no session-zone round trip)."""
    return hour_ts_from_index(hour_index(ts))


def calendar_columns(ts: Column | str) -> dict[str, Column]:
    """hour, day_of_week (Monday = 0) and month, as ints."""
    ts = _col(ts)
    return {
        "hour": F.hour(ts).cast("int"),
        "day_of_week": F.weekday(ts).cast("int"),
        "month": F.month(ts).cast("int"),
    }
