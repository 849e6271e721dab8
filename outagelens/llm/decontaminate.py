"""Benchmark decontamination: prefix-filtered set join of item windows against documents.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. An item's windows are its runs of
13 consecutive words, or all its words if they are fewer. A window is contained in a document if its words
stand there one after the other. For containment, one word of a window is prefix enough: the one that
is rarest in all documents. A document position with that word is joined to the windows it is the prefix of; the
window's start and end must lie in the document (positional and length bound); then all words are compared.

The items go in blocks of bounded size, so what is broadcast never exceeds ``BLOCK_WORDS`` window words.

Edge cases: null and wordless texts have no words and are never contaminated; wordless items have no windows;
repeated item rows are one item per item_id; null item_ids are ignored; empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagelens.llm.common import as_strings, others, slices, split_words, stored, table, translated

WINDOW = 13
#: words of windows in one block (about 13 words of 4 bytes each, and their vocabulary)
BLOCK_WORDS = 4_000_000

#: ASCII letters in lower case, digits as they are, other ASCII a blank
BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())

HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
                     T.StructField("items", T.ArrayType(T.StringType()))])


def words_of_items(items: Iterable[tuple[str, str]]) -> dict[tuple[str, ...], set[str]]:
    """Distinct windows with the item_ids that have them."""
    windows = defaultdict(set)
    for item, text in items:
        words = [w.decode() for w in (text or "").encode().translate(BYTES).split()]
        for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
            windows[tuple(words[i:i + WINDOW])].add(item)
    return windows


class Index:
    """Windows of a block of items, by their rarest word."""

    def __init__(self, windows: dict[tuple[str, ...], set[str]]):
        self.items = [sorted(x) for x in windows.values()]
        self.vocab = sorted({w for win in windows for w in win})
        code = {w: i for i, w in enumerate(self.vocab)}
        self.size = np.array([len(w) for w in windows], dtype=np.int64)
        self.words = np.full((len(windows), WINDOW), -1, dtype=np.int32)
        for i, win in enumerate(windows):
            self.words[i, :len(win)] = [code[w] for w in win]

    def order(self, counts: np.ndarray) -> None:
        """Choose each window's prefix: its rarest word by ``counts``, the first such."""
        cost = np.where(self.words >= 0, counts[self.words], np.iinfo(np.int64).max)
        self.at = cost.argmin(axis=1)
        key = self.words[np.arange(len(self.size)), self.at]
        self.by = np.argsort(key, kind="stable")
        self.first = np.searchsorted(key[self.by], np.arange(len(self.vocab) + 1))

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary code of each word (-1: not in any window) and the start of each text in them."""
        words = split_words(translated(texts, BYTES))
        code = pc.fill_null(pc.index_in(words.vocab, value_set=pa.array(self.vocab, pa.string())), -1)
        return np.asarray(code)[words.ids], words.starts

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words per text; the (text, window, first word) of each contained window as rows."""
        codes, starts = self.codes(texts)
        pos = np.flatnonzero(codes >= 0)
        pos = pos[np.diff(self.first)[codes[pos]] > 0]
        n = np.diff(self.first)[codes[pos]]
        lo = self.first[codes[pos]]
        win = self.by[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        start = np.repeat(pos, n) - self.at[win]
        doc = np.searchsorted(starts, np.repeat(pos, n), side="right") - 1
        fits = (start >= starts[doc]) & (start + self.size[win] <= starts[doc + 1])
        win, start, doc = win[fits], start[fits], doc[fits]
        for j in range(WINDOW):
            same = (self.words[win, j] < 0) | (self.words[win, j] == codes[np.minimum(start + j, len(codes) - 1)])
            win, start, doc = win[same], start[same], doc[same]
        return np.diff(starts), np.stack((doc, win, start - starts[doc]), axis=1)


def _blocks(spark: SparkSession, items: DataFrame) -> Iterator[dict[tuple[str, ...], set[str]]]:
    """Windows of the items in blocks of at most BLOCK_WORDS words (an item may go beyond it alone)."""
    rows = items.where("item_id is not null").select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    block, n = [], 0
    for r in rows.toLocalIterator():
        k = WINDOW * len((r[1] or "").split())
        if block and n + k > BLOCK_WORDS:
            yield words_of_items(block)
            block, n = [], 0
        block.append(tuple(r))
        n += k
    yield words_of_items(block)


def _ordered(docs: DataFrame, windows: dict[tuple[str, ...], set[str]]) -> Index:
    """The block's index, prefixes chosen by the counts of its words in all documents."""
    index = Index(windows)
    size = len(index.vocab)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            texts = as_strings(b.column(0))
            for lo, hi in slices(texts):
                codes, _ = index.codes(texts.slice(lo, hi - lo))
                total += np.bincount(codes[codes >= 0], minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["word", "n"])

    counts = np.zeros(size, dtype=np.int64)
    if size:  # as many rows as the block has words
        for r in docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
            counts[r["word"]] = r["n"]
    index.order(counts)
    return index


def hit_words(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with a column ``__hits``: n_words, the merged [from, to) spans of hit words, and item_ids found."""
    spark = docs.sparkSession

    def with_hits(docs: DataFrame, windows: dict, column: str, before: str | None) -> DataFrame:
        index = _ordered(docs, windows)
        shared = spark.sparkContext.broadcast(index)

        @F.arrow_udf(HITS)
        def find(texts: pa.Array) -> pa.Array:
            index, texts = shared.value, as_strings(texts)
            out = []
            for lo, hi in slices(texts):
                n_words, rows = index.hits(texts.slice(lo, hi - lo))
                spans, found = defaultdict(list), defaultdict(set)
                for d, w, s in sorted(map(tuple, rows.tolist()), key=lambda r: (r[0], r[2])):
                    e, own = s + int(index.size[w]), spans[d]
                    if own and s <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], e)
                    else:
                        own.append([s, e])
                    found[d].update(index.items[w])
                out += [{"n_words": int(n), "spans": spans.get(i, []), "items": sorted(found.get(i, []))}
                        for i, n in enumerate(n_words)]
            return pa.array(out, type=pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))),
                                                 ("items", pa.list_(pa.string()))]))

        got = docs.withColumn(column, find(F.col("text").cast("string")))
        if before is None:
            return got
        return got.withColumn(column, F.struct(
            F.col(f"{column}.n_words"), merged(F.concat(f"{before}.spans", f"{column}.spans")).alias("spans"),
            F.array_union(f"{before}.items", f"{column}.items").alias("items"))).drop(before)

    out, last = docs, None
    for k, windows in enumerate(_blocks(spark, items)):
        if last:  # a further block: what the blocks before found is written, and their index is dropped
            out = stored(out, "decontaminate")
        out = with_hits(out, windows, f"__hits{k}", last)
        last = f"__hits{k}"
    return out.withColumnRenamed(last, "__hits")


def merged(spans) -> F.Column:
    """Overlapping or touching [from, to) spans as one."""
    joined = F.aggregate(F.array_sort(spans), F.array().cast("array<array<bigint>>"), lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(F.element_at(done, -1), 2) >= s[0]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(
            F.element_at(F.element_at(done, -1), 1), F.greatest(F.element_at(F.element_at(done, -1), 2), s[1])))))
        .otherwise(F.concat(done, F.array(s))))
    return joined


def with_verdict(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (sorted item_ids as strings) and contaminated appended (or replaced)."""
    rest = others(docs, "n_words", "n_hit", "n_items", "items", "contaminated")
    found = hit_words(docs, items)
    n_hit = F.aggregate("__hits.spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    found = found.select(*rest, F.col("__hits.n_words").alias("n_words"), n_hit.alias("n_hit"),
                         F.size("__hits.items").cast("long").alias("n_items"), F.array_sort("__hits.items").alias("items"))
    return found.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_verdict(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""

QUERIES = {"op4_decontaminate": (op4_decontaminate, SQL)}
