"""Text cleaning and parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# month/day, two blanks, hour:minute:second; a single-digit hour is accepted
YEARLESS_PATTERN = r"^(\d{1,2})/(\d{1,2})\s+(\d{1,2}):(\d{2}):(\d{2})$"


def parse_yearless(text: Column, year: int) -> Column:
    """'MM/DD  HH:MM:SS' (surrounding blanks trimmed) in ``year`` -> timestamp_ntz; invalid (hour 24...) -> null."""
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, YEARLESS_PATTERN, i).try_cast("int")
    ok = t.rlike(YEARLESS_PATTERN)
    return F.when(ok, F.try_make_timestamp_ntz(F.lit(year), part(1), part(2), part(3), part(4), part(5)))


# fixed values: full date forms, tried in this order
FULL_PATTERNS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm", "yyyy-MM-dd")


def parse_free(text: Column, patterns: Sequence[str] = FULL_PATTERNS) -> Column:
    """Free-format text -> timestamp_ntz by the first pattern that fits; none -> null."""
    t = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in patterns]).cast("timestamp_ntz")


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text -> double, invalid -> null (D3: try_cast; a plain cast raises under ANSI)."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def keep_present(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Keep-list intersected with the columns present, in keep-list order."""
    return df.select(*[c for c in keep if c in df.columns])


def rename_first(df: DataFrame, name: str) -> DataFrame:
    """Rename the first column by position."""
    return df.withColumnRenamed(df.columns[0], name)


def strip_prefix_lower(c: Column, prefix: str) -> Column:
    """Remove a literal prefix text anywhere (not a regex) and lower-case."""
    return F.lower(F.replace(c, F.lit(prefix), F.lit("")))
