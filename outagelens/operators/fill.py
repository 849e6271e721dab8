"""Gap fill by row position: linear interpolation, then forward fill, then back fill.

Matches pandas ``interpolate('linear').ffill().bfill()`` on a gap-free series:
a gap between two known values is filled linearly in the row position, values
after the last known one repeat it, values before the first known one take it.

Plan: columns that are null in the same rows share one running window; which ones are is read off the
distinct null patterns of the written input, so it holds for that input whatever its columns are.
One summary row per (key, block) - built by partial hash aggregation - carries
the last/first known values across block borders through a small window per
key; the carries are joined onto the rows, which shuffles the rows once by
(key, block); then two running windows (ascending and descending - no
unbounded-following frame) give the nearest known value on each side.

With ``spans`` the input is only the rows where something is known, and the rest of each key's span is made here: all
that is shuffled, sorted and summed up are known rows and one marker a block, which holds what the block takes from the ones
before and after. A row then stands for the hours up to the next one, and only at the end becomes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outagelens.operators.blocked import BLOCK_ROWS, HALO_BLOCK, IS_HALO, block_of, with_halo
from outagelens.session import materialised

#: null patterns that are looked at; with more, every column has its own window
MOST_PATTERNS = 10_000
#: columns of ``spans``
FIRST, LAST, CONTEXT = "_first", "_last", "_context"


def alike_nulls(df: DataFrame, cols: Sequence[str]) -> list[list[str]]:
    """``cols`` in groups that are null in exactly the same rows of ``df``, from its distinct null patterns (few rows)."""
    bits = F.lit(0).cast("long")
    for k, c in enumerate(cols):
        bits = bits + F.when(F.col(c).isNull(), F.lit(1 << k)).otherwise(F.lit(0))
    masks = [r["_m"] for r in df.groupBy(bits.alias("_m")).agg(F.count(F.lit(1))).limit(MOST_PATTERNS + 1).collect()]
    if len(masks) > MOST_PATTERNS:
        return [[c] for c in cols]
    groups: dict[tuple, list[str]] = {}
    for k, c in enumerate(cols):
        groups.setdefault(tuple(m >> k & 1 for m in masks), []).append(c)
    return list(groups.values())


def _grouped(df: DataFrame, cols: Sequence[str], groups: Sequence[Sequence[str]] | None) -> list[list[str]]:
    """``cols`` in groups that are null in the same rows: those of ``groups``, or as found."""
    grouped = [[c for c in g if c in cols] for g in groups] if groups is not None else alike_nulls(df, cols)
    seen = {c for g in grouped for c in g}
    return [g for g in grouped if g] + [[c] for c in cols if c not in seen]


def _known(idx: str, g: Sequence[str]) -> Column:
    """(position, values...) of a row where the group is known, else null."""
    return F.when(F.col(g[0]).isNotNull(), F.struct(F.col(idx).alias("i"), *[F.col(c).alias(c) for c in g]))


def _part_of(idx: str, block: int, halo: int) -> Column:
    """A block's last ``halo`` rows are a part of their own, as they are in two blocks: parts 2b and 2b + 1 of block b."""
    home = block_of(F.col(idx), block)
    return home * 2 + (F.col(idx) - home * F.lit(block) >= F.lit(block - halo)).cast("long")


def _edges(parted: DataFrame, keys: Sequence[str], idx: str, part: str, grouped: Sequence[Sequence[str]]) -> DataFrame:
    """One row per block (part) with the last and first known position and values of each group, ``_bl`` and ``_bf``."""
    def at_edge(pick, k, g):
        """Position and values of a block's last or first known row of a group: plain values, so it is hash aggregated."""
        where = F.when(F.col(g[0]).isNotNull(), F.col(idx))
        edge, by = (F.max, F.max_by) if pick == "l" else (F.min, F.min_by)
        return [edge(where).alias(f"_b{pick}{k}_i"), *(by(c, where).alias(f"_b{pick}{k}_{j}") for j, c in enumerate(g))]

    summary = parted.groupBy(*keys, part).agg(*(a for k, g in enumerate(grouped) for pick in "lf" for a in at_edge(pick, k, g)))
    return summary.select(*keys, part, *(
        F.when(F.col(f"_b{pick}{k}_i").isNotNull(), F.struct(F.col(f"_b{pick}{k}_i").alias("i"), *(
            F.col(f"_b{pick}{k}_{j}").alias(c) for j, c in enumerate(g)))).alias(f"_b{pick}{k}")
        for k, g in enumerate(grouped) for pick in "lf"))


def _fill_spans(d: DataFrame, spans: DataFrame, keys: list[str], idx: str, linear: list[str], carry: list[str], block: int,
                groups: Sequence[Sequence[str]] | None, halo: int) -> DataFrame:
    """``gap_fill`` with ``spans``."""
    cols = linear + carry
    kinds = {c: d.schema[c].dataType for c in cols}
    grouped = _grouped(d, cols, groups)
    number = range(len(grouped))
    blk, part, step = HALO_BLOCK, "_part", 2 if halo else 1
    summary = _edges(d.withColumn(part, _part_of(idx, block, halo) if halo else block_of(F.col(idx), block)), keys, idx, part, grouped)
    first, last = F.col(FIRST), F.col(LAST)
    blocks = spans.withColumn(blk, F.explode(F.sequence(block_of(first, block), block_of(last, block)))).select(
        *keys, blk, (F.col(blk) * step).alias(part), F.greatest(first, F.col(blk) * block - halo).alias(idx),
        F.least(last, F.col(blk) * block + (block - 1)).alias("_stop"), CONTEXT)
    # a block's own parts (its halo's too) are nearer than a step
    before = Window.partitionBy(*keys).orderBy(F.col(part).asc()).rangeBetween(Window.unboundedPreceding, -step)
    after = Window.partitionBy(*keys).orderBy(F.col(part).desc()).rangeBetween(Window.unboundedPreceding, -step)
    markers = blocks.unionByName(summary, allowMissingColumns=True).select(
        *keys, blk, idx, "_stop", CONTEXT, F.lit(0).alias("_tag"),
        *(F.last(f"_bl{k}", ignorenulls=True).over(before).alias(f"_cp{k}") for k in number),
        *(F.last(f"_bf{k}", ignorenulls=True).over(after).alias(f"_cn{k}") for k in number)).where(F.col(blk).isNotNull())
    d = with_halo(d, idx, blk, block, halo) if halo else d.withColumn(blk, block_of(F.col(idx), block))
    d = d.select(*keys, blk, idx, F.lit(1).alias("_tag"), *cols).unionByName(markers, allowMissingColumns=True)
    # a fixed number: by size, Spark would merge the rows into few tasks before they grow
    d = d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, blk)
    w = Window.partitionBy(*keys, blk)
    ahead = w.orderBy(F.col(idx).desc(), F.col("_tag").desc()).rowsBetween(Window.unboundedPreceding, -1)
    order = w.orderBy(F.col(idx).asc(), F.col("_tag").asc())  # the marker, at the block's first position, comes first
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_n{k}": F.last(_known(idx, g), ignorenulls=True).over(ahead) for k, g in enumerate(grouped)})
    d = d.withColumns({
        **{f"_p{k}": F.last(F.coalesce(_known(idx, g), F.col(f"_cp{k}")), ignorenulls=True).over(up) for k, g in enumerate(grouped)},
        **{c: F.first(c).over(up) for c in ("_stop", CONTEXT, *(f"_cn{k}" for k in number))},
        "_next": F.lead(idx).over(order)})
    # a halo beyond the key's last block has no marker; a marker at a known row stands for nothing
    d = d.withColumn("_to", F.coalesce(F.col("_next") - 1, F.col("_stop"))).where(F.col("_stop").isNotNull() & (F.col("_to") >= F.col(idx)))
    # plain columns of a row's neighbours: cheap to repeat for each of its hours
    ends, flat = {k: (F.col(f"_p{k}"), F.coalesce(f"_n{k}", f"_cn{k}")) for k in number}, []
    for k, g in enumerate(grouped):
        p, n = ends[k]
        flat.append(p["i"].alias(f"_i{k}"))
        flat.append((n["i"] - p["i"]).alias(f"_w{k}"))  # null unless known on both sides
        for j, c in enumerate(g):
            flat.append(F.coalesce(p[c], n[c]).alias(f"_v{k}_{j}"))
            if c in linear:
                flat.append((n[c] - p[c]).alias(f"_d{k}_{j}"))
    d = d.select(*keys, blk, F.col(idx).alias("_from"), "_to", CONTEXT, *flat)
    context = [f.name for f in spans.schema[CONTEXT].dataType.elementType.fields]
    if context:
        d = d.withColumn(CONTEXT, F.explode_outer(CONTEXT)).withColumns({f"_c_{c}": F.col(CONTEXT)[c] for c in context})
    d = d.drop(CONTEXT).withColumn(idx, F.explode(F.sequence("_from", "_to")))
    out = {}
    for k, g in enumerate(grouped):
        at, width = F.col(f"_i{k}"), F.col(f"_w{k}")
        for j, c in enumerate(g):
            filled = F.col(f"_v{k}_{j}")
            if c in linear:
                lerp = filled + (F.col(idx) - at) * F.col(f"_d{k}_{j}") / width
                filled = F.when(width.isNull() | (at == F.col(idx)), filled).otherwise(lerp)
            out[c] = filled.cast(kinds[c]).alias(c)
    made = [F.col(blk), (F.col(idx) < F.col(blk) * block).alias(IS_HALO)] if halo else []
    return d.select(*keys, idx, *(F.col(f"_c_{c}").alias(c) for c in context), *(out[c] for c in cols), *made)


def gap_fill(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    linear: Sequence[str],
    carry: Sequence[str] = (),
    block: int = BLOCK_ROWS,
    write: bool = True,
    groups: Sequence[Sequence[str]] | None = None,
    halo: int = 0,
    spans: DataFrame | None = None,
) -> DataFrame:
    """Fill ``linear`` columns by interpolation and ``carry`` columns by ffill then bfill.

    ``groups`` may name columns that are null on exactly the same rows; by default they are found.
    With ``halo``, the last ``halo`` rows of a block also come, filled, in the next one (column ``HALO_BLOCK``), so that
    ``blocked_rolling`` on the result shuffles nothing: rows are sparse before they are filled.
    With ``spans`` (a row for each of ``keys``: FIRST and LAST position and CONTEXT, an array of structs, see ``hourly_spans``), ``df`` has
    the rows with known values, one a position and within the spans; the result has every position of the spans, one row for each entry
    of CONTEXT, whose fields become columns. A null key's positions are made too, with nothing known.
    """
    cols = list(linear) + list(carry)
    if spans is not None:
        return _fill_spans(materialised(df, "known") if write else df, spans, list(keys), idx, list(linear), list(carry), block, groups, halo)
    if not cols:
        return with_halo(df, idx, HALO_BLOCK, block, halo) if halo else df
    blk, part = (HALO_BLOCK, "_part") if halo else ("_fblk", "_fblk")
    # the input feeds three branches (null patterns, block summary and rows), so it is written once
    d = materialised(df, "grid") if write else df
    grouped = _grouped(d, cols, groups)
    if halo:
        parted = d.withColumn(part, _part_of(idx, block, halo))
        d = with_halo(d, idx, blk, block, halo)
    else:
        parted = d = d.withColumn(blk, block_of(F.col(idx), block))
    summary = _edges(parted, keys, idx, part, grouped)
    before = Window.partitionBy(*keys).orderBy(F.col(part).asc()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col(part).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carries = summary.select(
        *keys, part,
        *[F.last(f"_bl{k}", ignorenulls=True).over(before).alias(f"_cp{k}") for k in range(len(grouped))],
        *[F.last(f"_bf{k}", ignorenulls=True).over(after).alias(f"_cn{k}") for k in range(len(grouped))],
    )
    if halo:
        # a block begins with the halo of the one before: what is known before its first part and after its last one
        home = F.shiftright(part, 1)
        blocks = F.explode(F.when(F.col(part) % 2 != 0, F.array(home, home + 1)).otherwise(F.array(home)))
        carries = carries.withColumn(blk, blocks).groupBy(*keys, blk).agg(
            *(F.min_by(f"_cp{k}", part).alias(f"_cp{k}") for k in range(len(grouped))),
            *(F.max_by(f"_cn{k}", part).alias(f"_cn{k}") for k in range(len(grouped))))
    d = d.join(carries, [*keys, blk], "left")
    up = Window.partitionBy(*keys, blk).orderBy(F.col(idx).asc()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, blk).orderBy(F.col(idx).desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_p{k}": F.coalesce(F.last(_known(idx, g), ignorenulls=True).over(up), F.col(f"_cp{k}"))
                       for k, g in enumerate(grouped)})
    d = d.withColumns({f"_n{k}": F.coalesce(F.last(_known(idx, g), ignorenulls=True).over(down), F.col(f"_cn{k}"))
                       for k, g in enumerate(grouped)})

    out = {}
    for k, g in enumerate(grouped):
        p, n = F.col(f"_p{k}"), F.col(f"_n{k}")
        for c in g:
            pi, pv, ni, nv = p["i"], p[c], n["i"], n[c]
            if c in linear:
                lerp = pv + (F.col(idx) - pi) * (nv - pv) / (ni - pi)
                filled = F.when(p.isNotNull() & n.isNotNull() & (ni != pi), lerp).otherwise(F.coalesce(pv, nv))
            else:
                filled = F.coalesce(pv, nv)
            out[c] = F.coalesce(F.col(c), filled).cast(df.schema[c].dataType)
    helper = [f"_{x}{k}" for k in range(len(grouped)) for x in ("p", "n", "cp", "cn")]
    return d.withColumns(out).drop(*helper, *([] if halo else [blk]))
