"""Nearest as-of left join with tolerance (J1), without pairs and without a cartesian plan.

Semantics (pandas ``merge_asof(direction='nearest', tolerance=tol)``):
each left row takes the right row closest in time within ``tolerance``
(inclusive); on equal distance the earlier (backward) row wins; among right
rows with the same timestamp the backward side takes the last and the forward
side the first, in ``right_order``.

Plan: left and right rows are unioned and cut into time buckets of
``bucket`` (much wider than the tolerance) per ``by`` key.  Right rows within
``tolerance`` of a bucket border are copied into the neighbouring bucket.
One ascending and one descending running window per (by, bucket) yield the
previous and the next right row of every left row; no row pairs are formed
and a hot key is spread over many buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outagelens.functions.timefmt import micros_index


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str],
    tolerance_us: int,
    right_cols: Sequence[str],
    right_order: str | None = None,
    right_on: str | None = None,
    bucket_us: int | None = None,
) -> DataFrame:
    right_on = right_on or on
    bucket_us = bucket_us or 24 * tolerance_us
    if tolerance_us >= bucket_us:
        raise ValueError("bucket must be wider than the tolerance")
    t, tag, seq, payload, bkt = "_t", "_tag", "_seq", "_pl", "_bkt"

    lcols = left.columns
    l = left.select(
        *[F.col(c) for c in by],
        micros_index(F.col(on)).alias(t),
        F.lit(1).alias(tag),
        F.lit(None).cast("long").alias(seq),
        F.struct(*[F.col(c) for c in lcols]).alias("_left"),
        F.lit(None).alias(payload),
    )
    order_col = F.col(right_order).cast("long") if right_order else F.lit(0).cast("long")
    r = right.select(
        *[F.col(c) for c in by],
        micros_index(F.col(right_on)).alias(t),
        F.lit(0).alias(tag),
        order_col.alias(seq),
        F.lit(None).cast(left.select(F.struct(*[F.col(c) for c in lcols])).schema[0].dataType).alias("_left"),
        F.struct(micros_index(F.col(right_on)).alias("rt"), *[F.col(c) for c in right_cols]).alias(payload),
    )
    l = l.withColumn(payload, F.lit(None).cast(r.schema[payload].dataType))

    home = F.floor(F.col(t) / F.lit(bucket_us)).cast("long")
    l = l.withColumn(bkt, home)
    pos = F.col(t) - home * F.lit(bucket_us)
    r = r.withColumn(
        bkt,
        F.explode(F.array_compact(F.array(
            home,
            F.when(pos < F.lit(tolerance_us), home - 1),
            F.when(pos >= F.lit(bucket_us - tolerance_us), home + 1),
        ))),
    )
    u = l.unionByName(r)
    # right rows sort before left rows at equal time: an exact match is "backward"
    fwd = Window.partitionBy(*by, bkt).orderBy(F.col(t).asc(), F.col(tag).asc(), F.col(seq).asc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    bwd = Window.partitionBy(*by, bkt).orderBy(F.col(t).desc(), F.col(tag).desc(), F.col(seq).desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_prev", F.last(payload, ignorenulls=True).over(fwd)) \
         .withColumn("_next", F.last(payload, ignorenulls=True).over(bwd))
    u = u.filter(F.col(tag) == 1)
    db = F.col(t) - F.col("_prev.rt")
    dn = F.col("_next.rt") - F.col(t)
    ok_b = F.col("_prev").isNotNull() & (db <= F.lit(tolerance_us))
    ok_n = F.col("_next").isNotNull() & (dn <= F.lit(tolerance_us))
    pick = F.when(ok_b & (~ok_n | (db <= dn)), F.col("_prev")).when(ok_n, F.col("_next"))
    return u.select(
        *[F.col(f"_left.{c}").alias(c) for c in lcols],
        *[pick[c].alias(c) for c in right_cols],
    )


def asof_nearest_grid(
    right: DataFrame,
    by: Sequence[str],
    right_on: str,
    step_us: int,
    tolerance_us: int,
    right_cols: Sequence[str],
    right_order: str | None = None,
    grid_idx: str = "hidx",
) -> DataFrame:
    """Nearest as-of match for every point of a regular grid (position i = time i * step).

    Same semantics as ``asof_nearest``, specialised to a regular left side: a right row
    can only be nearest for grid points within ``tolerance``, so it is copied to those
    few points and the best copy per point wins by ``min_by`` on the key
    (distance, forward?, order) - backward wins ties, the last duplicate backward, the
    first forward.  Partial aggregation runs map-side (Spark sorts to aggregate structs); no pairs.
    Returns (by..., grid_idx, right_cols...) for grid points with a match only.
    """
    t = micros_index(F.col(right_on))
    k_lo = F.ceil((t - F.lit(tolerance_us)) / F.lit(step_us)).cast("long")
    k_hi = F.floor((t + F.lit(tolerance_us)) / F.lit(step_us)).cast("long")
    seq = F.col(right_order).cast("long") if right_order else F.lit(0).cast("long")
    r = right.select(*[F.col(c) for c in by], t.alias("_t"), seq.alias("_seq"),
                     F.struct(*[F.col(c) for c in right_cols]).alias("_pl"),
                     F.explode(F.sequence(k_lo, k_hi)).alias(grid_idx))
    gt = F.col(grid_idx) * F.lit(step_us)
    fwd = F.col("_t") > gt
    key = F.struct(F.abs(F.col("_t") - gt).alias("d"), fwd.cast("int").alias("f"),
                   F.when(fwd, F.col("_seq")).otherwise(-F.col("_seq")).alias("s"))
    best = r.groupBy(*by, grid_idx).agg(F.min_by("_pl", key).alias("_pl"))
    return best.select(*by, grid_idx, *[F.col(f"_pl.{c}").alias(c) for c in right_cols])
