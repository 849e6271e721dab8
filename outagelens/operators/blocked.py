"""Order-dependent work on long series without a single hot partition.

A series is keyed by ``keys`` and a dense integer position ``idx`` (on an hourly
grid the epoch hour is such a position).  Rows are cut into blocks of
``block`` positions; window functions run per ``(keys, block)``.  Bounded
look-back frames get a halo: the last ``halo`` rows of each block are copied
into the next block and dropped after the window.  Unbounded carries (last
non-null, running counts) are finished with a second, small window over one
summary row per block.  A site holding a third of all rows therefore spreads
over ``span / block`` tasks instead of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outagelens.session import cut_lineage

BLOCK_ROWS = 2048
_HOME = "_home_blk"
IS_HALO = "_is_halo"
#: block column of rows that come with their halo (``gap_fill`` with ``halo``)
HALO_BLOCK = "_wblk"


def block_of(idx: Column, block: int) -> Column:
    return F.floor(idx / F.lit(block)).cast("long")


def with_halo(df: DataFrame, idx: str, block_col: str, block: int = BLOCK_ROWS, halo: int = 24) -> DataFrame:
    """Add ``block_col``; rows in the last ``halo`` positions of a block also appear in the next one."""
    if halo >= block:
        raise ValueError("halo must be smaller than the block")
    home = block_of(F.col(idx), block)
    pos = F.col(idx) - home * F.lit(block)
    return (
        df.withColumn(_HOME, home)
        .withColumn(
            block_col,
            F.explode(F.when(pos >= F.lit(block - halo), F.array(F.col(_HOME), F.col(_HOME) + 1))
                      .otherwise(F.array(F.col(_HOME)))),
        )
        .withColumn(IS_HALO, F.col(block_col) != F.col(_HOME))
        .drop(_HOME)
    )


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(IS_HALO)).drop(IS_HALO)


def halo_window(keys: Sequence[str], block_col: str, idx: str) -> Window:
    return Window.partitionBy(*keys, block_col).orderBy(idx)


def blocked_rolling(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    build: "callable",
    halo: int,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply ``build(window) -> dict[name, Column]`` with look-back up to ``halo`` rows (rows that have their halo keep it until here)."""
    blk = HALO_BLOCK
    h = df if blk in df.columns else with_halo(df, idx, blk, block=block, halo=max(halo, 1))
    cols = build(halo_window(keys, blk, idx))
    return drop_halo(h.withColumns(cols)).drop(blk)


def range_blocks(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` range-partitioned by ``order`` on sampled boundaries, with the partition's number as ``name``.

    Partitions follow the number of rows, not calendar days or equal widths of values. The result is
    checkpointed, so the numbers stay the same in every branch that reads it.
    """
    return cut_lineage(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def sequence_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_idx") -> DataFrame:
    """0-based row number per ``keys`` in ``order`` without one task per key.

    Rows are range-partitioned, sorted and written once with their place in the partition. One small row for each
    (keys, partition) has the key's first place there and, by a window over these rows, the number of its rows before;
    so the rows themselves are shuffled and written only once. Without keys these rows are one a partition and are broadcast.
    """
    keys, blk = list(keys), "_sblk"
    d = cut_lineage(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
                    .withColumn("_place", F.monotonically_increasing_id()))
    # the id has the partition in its upper bits and the row's place in the lower 33
    d = d.withColumn(blk, F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = d.groupBy(*keys, blk).agg(F.count(F.lit(1)).alias("_blk_n"), F.min("_place").alias("_blk_lo"))
    wo = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(counts.select(*keys, blk, (F.coalesce(F.sum("_blk_n").over(wo), F.lit(0)) - F.col("_blk_lo")).alias("_blk_off")))
    return (
        d.join(offsets if keys else F.broadcast(offsets), [*keys, blk], "left")
        .withColumn(name, (F.col("_place") + F.col("_blk_off")).cast("long"))
        .drop("_place", "_blk_off", blk)
    )
