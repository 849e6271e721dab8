"""Failure-tolerant ingest (O1): every source is read on its own, a failed one leaves its consumers their defaults."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from outagelens.session import materialised

OK, EMPTY, ABSENT, FAILED = "ok", "empty", "absent", "failed"


@dataclass(frozen=True)
class Source:
    name: str
    load: Callable[[], DataFrame]
    required: bool = False


@dataclass(frozen=True)
class Outcome:
    name: str
    status: str
    n_rows: int
    why: str | None
    table: DataFrame | None


def ingest(sources: Sequence[Source]) -> dict[str, Outcome]:
    """Reads each source to its end and writes it once. ``absent``: its path isn't there; ``failed``: anything else, with the
    error's first line. A required source that isn't read raises."""
    found = {}
    for s in sources:
        try:
            df = materialised(s.load(), f"source-{s.name}")
            n = df.count()
            found[s.name] = Outcome(s.name, OK if n else EMPTY, n, None, df if n else None)
        except Exception as e:  # noqa: BLE001  (any failure of a source is its own)
            if s.required:
                raise
            missing = isinstance(e, AnalysisException) and "PATH_NOT_FOUND" in str(e)
            found[s.name] = Outcome(s.name, ABSENT if missing else FAILED, 0, str(e).splitlines()[0], None)
    return found


def status_table(spark: SparkSession, found: dict[str, Outcome]) -> DataFrame:
    """source, status, n_rows: a row for each source."""
    return spark.createDataFrame([(o.name, o.status, o.n_rows) for o in found.values()], "source string, status string, n_rows long")
