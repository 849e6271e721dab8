"""Connected components by alternating stars, two shuffles a round.

Edges are sorted by node and neighbour, so a node's least neighbour comes first and a task streams through nodes of any
degree. Large star: the larger neighbours go to the least of node and neighbours. Small star: the node and its smaller neighbours
go to the least. They alternate until the edges are stars; a large star that finds only centres and leaves says so.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outagelens.llm.common import stored

_NAMES = ["a", "b", "done"]


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct rows (a, b) sorted by a and b: node, neighbour, least neighbour and whether the row is a node's first."""
    last = None
    for batch in batches:
        a, b = (np.asarray(batch.column(i)) for i in (0, 1))
        if not len(a):
            continue
        before = (a[0], b[0] - 1 if last is None else b[0], b[0]) if last is None or last[0] != a[0] else last
        new = np.ones(len(a), dtype=bool)
        new[1:] = a[1:] != a[:-1]
        goes_on = last is not None and last[0] == a[0]
        new[0] = not goes_on
        same = np.zeros(len(a), dtype=bool)
        same[1:] = ~new[1:] & (b[1:] == b[:-1])
        same[0] = goes_on and before[1] == b[0]
        first = np.flatnonzero(new)
        least = np.empty(len(a), dtype=np.int64)
        head = first[0] if len(first) else len(a)
        least[:head] = before[2]
        least[head:] = np.repeat(b[first], np.diff(first, append=len(a)))
        last = (a[-1], b[-1], least[-1])
        yield a[~same], b[~same], least[~same], new[~same]


def _large(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for a, b, least, first in _runs(batches):
        centre = a < least
        to = np.where(centre, a, least)
        # of a leaf only its centre is a neighbour; anything else isn't a star yet
        others = ~centre & ~first
        rows = others | (centre & (b > a))
        out = np.where(rows & (b > a), b, a)[rows], to[rows], centre[rows]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=_NAMES)


def _small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for a, b, least, first in _runs(batches):
        # the first row links the node, the others link its neighbours
        yield pa.RecordBatch.from_arrays([pa.array(np.where(first, a, b)), pa.array(least), pa.array(np.zeros(len(a), bool))], names=_NAMES)


def _starred(edges: DataFrame, star) -> DataFrame:
    return edges.repartition("a").sortWithinPartitions("a", "b").mapInArrow(star, "a long, b long, done boolean")


def components(links: DataFrame) -> DataFrame:
    """(node, class) for each node of ``links`` (a, b) that isn't its class, which is the smallest node connected to it."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    while True:
        # both directions from one pass: a union would make the edges, a star of the round before, twice
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        large = stored(_starred(both, _large), "stars")
        if large.where("not done").isEmpty():
            return large.select(F.col("a").alias("node"), F.col("b").alias("class"))
        edges = _starred(large.select("a", "b"), _small).where("a <> b")
