"""Best-fit packing of documents into sequences of at most 4,096 tokens, in bulk-synchronous rounds.

Documents are tokenized; longer ones are cut into pieces of 4,096 tokens and a rest. Full pieces are sequences
of their own. The others are placed in waves of falling size, (max / 2, max], (max / 3, max / 2] and so on:

1. Sweep: the wave's pieces and the open gaps of at least the wave's least size are range-sorted together by
   falling size. Each partition passes over its run once, keeps the gaps it has passed sorted, and puts each piece in the
   smallest of them that holds it; what is left of the gap is a gap again.
2. Carry: pieces that found no gap in their partition, and gaps that are left, are numbered by rank in each
   partition. From the numbers of both (a row for each partition) it follows which ranks meet across partitions: like
   brackets, a piece takes the nearest gap before it that no other has taken; a gap has a rank for each piece of the
   wave that surely fits. Pieces and gaps are joined by rank.
3. Open: pieces that still have no place are swept again; now a piece without a gap opens a sequence.

Gaps are updated and written after each step, so no step recomputes those before it.

Edge cases: a null or empty text is the one end id; rows that share a doc_id, or lack one, are packed row by row;
other columns are ignored; no documents give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outagelens.llm.common import stored, table
from outagelens.llm.tokens import crc32_le, default_path, encoded

MAX_TOKENS = 4096
#: the waves' upper bounds are MAX_TOKENS divided by these
DIVISORS = [1, 2, 3, 5, 10, 40]
#: rows of a partition of a sweep
SWEEP_ROWS = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
STATE = "uid long, length int, bin long, offset int, space int, part int, rank int, slots int"


def cut_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The pieces of every document, in tokens."""
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, ids, starts in encoded(b.column(1), tokenizer_path):
                size = np.diff(starts)
                n = -(-size // max_tokens)
                row = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = piece * max_tokens
                length = np.minimum(size[row] - at, max_tokens)
                first = starts[row] + at
                crc = [crc32_le(ids[s:s + k]) for s, k in zip(first, length, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(at, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def _sweep(open_new: bool, widest: int, max_tokens: int):
    """Best fit in one sorted run. Rows: pieces (uid set) and gaps (uid null), by falling size, gaps first."""
    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        gaps: list[tuple[int, int, bool]] = []  # (space, bin, used in this sweep), ascending
        pieces: list[tuple[int, int, int | None, int | None]] = []
        unplaced = 0
        for b in batches:
            for uid, length, own, space in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if uid is None:
                    insort(gaps, (space, own, False))
                    continue
                at = bisect_left(gaps, (length, -1 << 63))
                if at < len(gaps):
                    space, own, _ = gaps.pop(at)
                elif open_new:
                    space, own = max_tokens, uid
                else:
                    pieces.append((uid, length, None, None))
                    unplaced += 1
                    continue
                pieces.append((uid, length, own, max_tokens - space))
                if space > length:
                    insort(gaps, (space - length, own, True))
        rank = 0
        rows = []
        for uid, length, own, offset in pieces:
            rows.append((uid, length, own, offset, None, part, rank if own is None else None, None))
            rank += own is None
        # gaps are numbered from the smallest, the nearest to the pieces of later partitions, with a number for
        # each piece that surely fits: one if the gap is as it came, as later pieces are no larger; or more by size
        rank = 0
        for space, own, used in gaps:
            slots = max(0 if used else 1, space // widest)
            rows.append((None, None, own, None, space, part, rank, slots))
            rank += slots
        kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 5]
        for lo in range(0, len(rows), 50_000):
            cols = zip(*rows[lo:lo + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             names=["uid", "length", "bin", "offset", "space", "part", "rank", "slots"])

    return sweep


def _swept(pieces: DataFrame, gaps: DataFrame, rows: int, open_new: bool, widest: int, max_tokens: int) -> DataFrame:
    both = pieces.select("uid", "length", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("int").alias("space"),
                         F.col("length").alias("size"), F.lit(1).alias("kind"), F.col("uid").alias("key")).unionByName(
        gaps.select(F.lit(None).cast("long").alias("uid"), F.lit(None).cast("int").alias("length"), "bin", "space",
                    F.col("space").alias("size"), F.lit(0).alias("kind"), F.col("bin").alias("key")))
    by = [F.desc("size"), "kind", "key"]
    return stored(both.repartitionByRange(-(-rows // SWEEP_ROWS), *by).sortWithinPartitions(*by)
                  .select("uid", "length", "bin", "space").mapInArrow(_sweep(open_new, widest, max_tokens), STATE), "sweep")


def _meetings(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which ranks meet: (piece part, from rank, to rank, gap part, first gap rank), from (part, pieces, gaps) rows.

    A stack of the gaps left by the partitions so far; a partition's pieces take from its top, smallest gaps first."""
    stack: list[list[int]] = []  # part, next rank, gaps in all
    out = []
    for part, pieces, gaps in sorted(counts):
        done = 0
        while done < pieces and stack:
            top = stack[-1]
            n = min(pieces - done, top[2] - top[1])
            out.append((part, done, done + n, top[0], top[1]))
            done, top[1] = done + n, top[1] + n
            if top[1] == top[2]:
                stack.pop()
        if gaps:
            stack.append([part, 0, gaps])
    return out


def pack(items: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """uid, sequence_id and offset for ``items`` (uid: distinct long, length: at most max_tokens), a written table."""
    spark = items.sparkSession
    items = items.select("uid", F.col("length").cast("int").alias("length"))
    bounds = sorted({max_tokens // d for d in DIVISORS if max_tokens // d} | {0}, reverse=True)
    wave_of = F.lit(-1)
    for w, (hi, lo) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        wave_of = F.when((F.col("length") <= hi) & (F.col("length") > lo), w).otherwise(wave_of)
    sizes = dict(items.groupBy(wave_of.alias("wave")).count().collect())
    # more than half a sequence: one each
    alone = items.where(F.col("length") > bounds[1]).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).alias("offset"), "length")
    placed = [alone.select("uid", "sequence_id", "offset")]
    gaps = alone.select(F.col("sequence_id").alias("bin"), (max_tokens - F.col("length")).alias("space")).where("space > 0")
    n_gaps = sizes.get(0, 0)
    for w in range(1, len(bounds) - 1):
        hi, lo = bounds[w], bounds[w + 1]
        if not sizes.get(w):
            continue
        pieces = items.where((F.col("length") <= hi) & (F.col("length") > lo))
        small, state = gaps.where(F.col("space") <= lo), None
        steps = (False, True) if n_gaps else (True,)
        fit, left_over = gaps.where(F.col("space") > lo), sizes[w]
        for open_new in steps:
            if not left_over:
                break
            state = _swept(pieces, fit, left_over + n_gaps, open_new, hi, max_tokens)
            placed.append(state.where("uid is not null and bin is not null").select("uid", F.col("bin").alias("sequence_id"), "offset"))
            pieces = state.where("uid is not null and bin is null")
            fit = state.where("uid is null").select("bin", "space")
            if open_new:
                continue
            counts = state.where("rank is not null").groupBy("part").agg(
                F.count("uid").alias("pieces"), F.coalesce(F.sum("slots"), F.lit(0)).cast("int").alias("gaps")).collect()
            meet = _meetings([tuple(r) for r in counts])
            left_over = sum(r["pieces"] for r in counts) - sum(to - first for _, first, to, _, _ in meet)
            if not meet:
                continue
            # at most two rows for each partition
            meet = spark.createDataFrame(meet, "part int, lo int, hi int, gap_part int, gap_rank int")
            left = pieces.join(F.broadcast(meet), "part").where("rank >= lo and rank < hi").select(
                "uid", "length", F.col("gap_part").alias("part"), (F.col("gap_rank") + F.col("rank") - F.col("lo")).alias("rank"))
            free = state.where("uid is null")
            slots = free.where("slots > 0").select("part", "bin", "space", F.explode(F.expr("sequence(rank, rank + slots - 1)")).alias("rank"))
            before = Window.partitionBy("bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
            taken = stored(slots.join(left, ["part", "rank"]).select("uid", "bin", "length", (
                max_tokens - F.col("space") + F.coalesce(F.sum("length").over(before), F.lit(0))).cast("int").alias("offset")), "carry")
            placed.append(taken.select("uid", F.col("bin").alias("sequence_id"), "offset"))
            pieces = pieces.select("uid", "length").join(taken.select("uid"), "uid", "left_anti")
            used = taken.groupBy("bin").agg(F.sum("length").alias("used"))
            fit = free.select("bin", "space").join(used, "bin", "left").select(
                "bin", (F.col("space") - F.coalesce("used", F.lit(0))).cast("int").alias("space")).where("space > 0")
        gaps = small.select("bin", "space").unionByName(fit)
        if w % 2 == 0:
            gaps = stored(gaps, "gaps")
        n_gaps += sizes[w] // max(1, max_tokens // hi)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset in the sequence."""
    pieces = stored(cut_pieces(docs, tokenizer_path, max_tokens).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces, max_tokens), "uid").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_path())


QUERIES = {"op3_packing": (op3_packing, None)}
