"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio with a deterministic threshold.

Words are ``[^\\x20\\x09-\\x0D]+``. The raw corpus (all documents) and the trusted target (labelled rows of good
quality that aren't toxic) are two multinomials over hashed words and word pairs. A document's score is the mean
of log(target / raw) over its n-grams, in integer millionths, so it is the same however rows are split.
The threshold is the one that best separates labelled rows that pass the base rules and gave no target counts (half of
them, by a hash of doc_id), but none that would reject more than ``MAX_LOST`` of the good ones; good are there, too, those
of good quality that aren't toxic, and all others are bad. Without labels of both kinds only the base rules decide.

Every labelled row is used: the raw and target counts, the scores and the threshold take all documents and labels. The
labels are joined by doc_id; only texts whose id may be labelled, by ``LABEL_BITS`` bits of a hash, are shuffled for it, and
the join is exact. The threshold comes from cumulative counts in Spark, by ranges of ``SCORE_RANGE`` scores.

Edge cases: null, empty and wordless texts have zero counts and fail the base rules (under 50 words); a doc_id with
several labels has the worst one; null labels and doc_ids are not used; extra columns are kept; empty tables work.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outagelens.llm.common import Words, as_strings, hash64, mix64, others, slices, split_words, stored, table, window_hashes

BUCKETS = 1 << 16
MAX_LOST = 0.005
SMOOTHING = 1.0
UNIT = 1_000_000
#: scores of a range of the threshold's counts; scores are mean logarithms in millionths, so there are a few thousand ranges
SCORE_RANGE = 8192
MIN_WORDS = 50
#: bits of the set of labelled ids that is broadcast, 64 a row; with more ids than that only more texts are shuffled
LABEL_BITS = 1 << 26

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]


def buckets(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, of each pair of words, and whether the pair lies in one text."""
    h = hash64(words.vocab)
    shift = np.uint64(48)
    one = (mix64(h + np.uint64(1)) >> shift).astype(np.int64)[words.ids]
    two = (window_hashes(h[words.ids], 2) >> shift).astype(np.int64)
    return one, two, inside(words.doc_of(), 2)


def inside(doc: np.ndarray, n: int) -> np.ndarray:
    """For each run of n consecutive words of one flat list, whether all are of one text; ``doc``: each word's text."""
    return doc[:max(0, len(doc) - n + 1)] == doc[n - 1:]


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[starts[1:]] - total[starts[:-1]]


def repeated_words(words: Words, n: int = 3) -> np.ndarray:
    """Words of each text that lie in a run of n words found twice or more in that text."""
    doc = words.doc_of()
    ok = inside(doc, n)
    if not ok.any():
        return np.zeros(len(words.starts) - 1, dtype=np.int64)
    key = window_hashes(hash64(words.vocab)[words.ids], n) + mix64(doc[:len(ok)].astype(np.uint64) + np.uint64(7))
    at = np.flatnonzero(ok)
    key = mix64(key[at])
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    covered = np.zeros(len(words.ids), dtype=bool)
    if len(twice):
        at = at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
        for k in range(n):
            covered[at + k] = True
    return sums(covered, words.starts)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lines = pc.split_pattern(texts, "\n")
    enc = lines.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lines.offsets)))
    full = (np.asarray(pc.binary_length(pc.ascii_trim_whitespace(enc.dictionary))) > 0)[np.asarray(enc.indices)]
    key = doc[full] * len(enc.dictionary) + np.asarray(enc.indices)[full]
    return (np.bincount(doc[full], minlength=len(texts))
            - np.bincount(np.unique(key) // max(1, len(enc.dictionary)), minlength=len(texts)))


def rated(texts: pa.Array, ratio: np.ndarray) -> list[np.ndarray]:
    """The columns of STATS for a slice of texts."""
    words = split_words(texts)
    n = np.diff(words.starts)
    chars = np.asarray(pc.utf8_length(words.vocab))[words.ids]
    marks = np.asarray(pc.count_substring_regex(words.vocab, "[#*$%&|<>]"))[words.ids]
    one, two, ok = buckets(words)
    pairs = np.zeros(len(one), dtype=np.int64)
    pairs[:len(two)] = np.where(ok, ratio[two], 0)
    total = sums(ratio[one] + pairs, words.starts)
    grams = n + np.maximum(n - 1, 0)
    score = total // np.maximum(grams, 1)
    return [n, sums(chars, words.starts), sums(marks, words.starts), repeated_lines(texts), repeated_words(words), score]


def labelled(labels: DataFrame) -> DataFrame:
    """Every labelled doc_id once: doc_id, trusted (good and not toxic), and whether it is for the fit or the threshold.

    Written, so that Spark knows its size and broadcasts it only where it is small."""
    rows = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
            .agg(F.min(F.expr("int(quality = 1 and coalesce(toxic, 0) = 0)")).alias("trusted"))
            .withColumn("fit", F.xxhash64(F.lit("fit"), "doc_id") % 2 == 0))
    return stored(rows, "labelled")


def maybe_labelled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``, and few others: those whose hash is that of one of them."""
    bit = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(LABEL_BITS))
    word, mask = F.shiftright(bit, 6), F.expr("shiftleft(1L, int(__bit % 64))")
    known = (ids.select(bit.alias("__bit")).select(F.shiftright("__bit", 6).alias("__word"), mask.alias("__mask"))
             .groupBy("__word").agg(F.bit_or("__mask").alias("__known")))  # LABEL_BITS / 64 rows at most
    return (docs.withColumn("__bit", bit).withColumn("__word", word).join(F.broadcast(known), "__word")
            .where(F.col("__known").bitwiseAND(mask) != 0).drop("__bit", "__word", "__known"))


def log_ratios(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket in millionths, from counts over all documents."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            texts = as_strings(b.column(0))
            for lo, hi in slices(texts):
                one, two, ok = buckets(split_words(texts.slice(lo, hi - lo)))
                found += np.bincount(one, minlength=BUCKETS) + np.bincount(two[ok], minlength=BUCKETS)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["bucket", "n"])

    def counts(rows: DataFrame) -> np.ndarray:
        total = (rows.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long")
                 .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())  # a row for each bucket
        out = np.zeros(BUCKETS)
        out[total["bucket"]] = total["n"]
        return out

    trusted = sample.where("fit and trusted = 1").select("doc_id")
    target = counts(maybe_labelled(docs, trusted).join(trusted, "doc_id"))
    if not target.sum():
        return np.zeros(BUCKETS, dtype=np.int64)
    raw = counts(docs)
    of = lambda x: np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS))
    return np.rint(UNIT * (of(target) - of(raw))).astype(np.int64)


def base_failed() -> F.Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words")


def scored(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``docs`` with the columns of STATS and base_failed appended."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    kind = pa.struct([(c, pa.int64()) for c in STATS])

    @F.arrow_udf(", ".join(f"{c}: long" for c in STATS).join(("struct<", ">")))
    def rate(texts: pa.Array) -> pa.Array:
        texts, parts = as_strings(texts), [np.zeros((len(STATS), 0), dtype=np.int64)]
        parts += [np.stack(rated(texts.slice(lo, hi - lo), shared.value)) for lo, hi in slices(texts)]
        return pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(parts, axis=1)], fields=list(kind))

    rest = others(docs, *STATS, "base_failed")
    found = docs.withColumn("__rated", rate(F.col("text").cast("string")))
    return found.select(*rest, *(F.col(f"__rated.{c}").alias(c) for c in STATS)).withColumn("base_failed", base_failed())


def threshold(docs: DataFrame, sample: DataFrame, ratio: np.ndarray) -> int | None:
    """The least score that is kept, from the labelled rows; None if only one kind of them is there."""
    judged = sample.where("not fit").select("doc_id", "trusted")
    own = maybe_labelled(docs.select("doc_id", "text"), judged).join(judged, "doc_id")
    # written, so that texts are rated once
    rated = stored(scored(own, ratio).select("doc_id", "score", "base_failed", "trusted"), "rated-labels")
    rows = rated.where("not base_failed").groupBy("doc_id").agg(F.min("score").alias("score"), F.min("trusted").alias("trusted"))
    good = (F.col("trusted") == 1).cast("long")
    cuts = stored(rows.groupBy("score").agg(F.sum(good).alias("good"), F.sum(1 - good).alias("bad"))
                  .withColumn("range", F.floor(F.col("score") / SCORE_RANGE)), "cuts")
    total = cuts.agg(F.sum("good"), F.sum("bad")).first()
    if not total[0] or not total[1]:
        return None
    # good and bad rows below each score: those of earlier ranges (a row for each range) and those before it in its own
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = cuts.groupBy("range").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    below = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    ranges = ranges.select("range", *(below(c, before.orderBy("range")).alias(f"{c}_earlier") for c in ("good", "bad")))
    inside_range = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    lost, caught = ((F.col(f"{c}_earlier") + below(c, inside_range)) / n for c, n in zip(("good", "bad"), total, strict=True))
    gains = cuts.join(ranges, "range").select("score", lost.alias("lost"), caught.alias("caught"))
    gain = F.when(F.col("lost") <= MAX_LOST, F.col("caught") - F.col("lost")).otherwise(-1.0)
    best = gains.orderBy(gain.desc(), "score").select("score").first()[0]
    # halfway between the best row that goes and the worst that stays
    worse = cuts.where(F.col("score") < best).agg(F.max("score")).first()[0]
    return int(best) if worse is None else int((worse + best + 1) // 2)


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with the columns of STATS, base_failed and kept appended (or replaced)."""
    sample = labelled(labels)
    own = docs.select("doc_id", "text")
    ratio = log_ratios(own, sample)
    least = threshold(own, sample, ratio)
    passed = F.lit(True) if least is None else F.col("score") >= least
    return scored(docs, ratio).withColumn("kept", ~F.col("base_failed") & passed)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_quality(docs, table(spark, sf_dir, "labels"))
    return rows.select("doc_id", *STATS[:-1], "base_failed", "kept", (F.col("score") / UNIT).alias("score"))


QUERIES = {"op2_quality": (op2_quality, None)}
