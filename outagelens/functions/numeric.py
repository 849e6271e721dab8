"""Portable numeric helpers (column expressions, plus their SQL twins for oracles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# fixed value: 2^53, from which doubles have no fractions
EXACT = 9007199254740992.0


def rnd(c: Column | str, n: int = 6) -> Column:
    """Round half-up to ``n`` digits as ``floor(x*10^n + 0.5) / 10^n``.

    Spark's ``round`` and DuckDB's ``round`` disagree on binary ties; this form is
    bit-identical on both engines, so results hash the same as the SQL oracle.
    Values from 2^53 / 10^n on have no such digits and pass unchanged, as do NaN and
    infinities (NaN compares as the largest value on both engines).
    """
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    scale = float(10 ** n)
    return F.when(F.abs(c) * F.lit(scale) >= F.lit(EXACT), c).otherwise(
        (F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double"))


def rnd_sql(expr: str, n: int = 6) -> str:
    scale = f"1e{n}"
    return (f"CASE WHEN abs(CAST({expr} AS DOUBLE)) * {scale} >= {EXACT} THEN CAST({expr} AS DOUBLE) "
            f"ELSE CAST(floor(({expr}) * {scale} + 0.5) / {scale} AS DOUBLE) END")


def r6_sql(expr: str) -> str:
    return rnd_sql(expr, 6)


def rnd_even(c: Column | str, n: int = 0) -> Column:
    """Round half to even: ``rint(x * 10^n) / 10^n``, as numpy does."""
    return F.rint((F.col(c) if isinstance(c, str) else c) * F.lit(float(10 ** n))) / F.lit(float(10 ** n))


def fixed(c: Column | str, n: int = 6) -> Column:
    """``c`` rounded half-up to ``n`` digits as a decimal: sums of it don't depend on the order of rows or tasks."""
    return rnd(c, n).cast(f"decimal(20,{n})")


def fixed_sql(expr: str, n: int = 6) -> str:
    return f"CAST({rnd_sql(expr, n)} AS DECIMAL(20, {n}))"


def safe_ratio(num: Column, den: Column, fill: float = 0.0) -> Column:
    """num/den with zero or null denominators (and null numerators) mapped to ``fill``."""
    return F.coalesce(F.try_divide(num, F.nullif(den, F.lit(0.0))), F.lit(fill))


def clip01(c: Column) -> Column:
    """Clamp to [0, 1]; nulls must be handled before (greatest/least skip nulls)."""
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def flag(cond: Column) -> Column:
    """Boolean condition as 0/1 int, null condition counts as 0 (pandas NaN > x is False)."""
    return F.coalesce(cond, F.lit(False)).cast("int")
