"""Language ID by compression: one zstandard raw-content dictionary for each language, the smallest output wins.

A dictionary is made of one passage from each of at most ``SAMPLE_DOCS`` documents of its language, those with
the smallest hash of doc_id (the documented bound of the fit). Every whole text, in lower case and with a blank for
each run of non-letters, is compressed in pieces of ``PIECE`` bytes with each dictionary; the language with the fewest bytes in all is predicted, ties by name. A
prediction whose margin to the next language is under ``MIN_MARGIN`` of the bytes is marked ``rejected``.

Edge cases: a null text or one without a letter is ``und`` with score 0; rows with null lang or doc_id are not learnt
from; without any learnt language all are ``und``; one learnt language is always predicted, with score 1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outagelens.llm.common import as_strings, others, table

SAMPLE_DOCS = 128
PASSAGE = 1024
PIECE = 4096
LEVEL = 6
MIN_MARGIN = 0.02

_LETTER = regex.compile(r"\p{L}")
_OTHERS = regex.compile(r"[^\p{L}]+")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def dictionaries(train: DataFrame) -> dict[str, bytes]:
    """Raw-content dictionary of each language of ``train`` (doc_id, text, lang)."""
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (train.where("lang is not null and doc_id is not null").select("doc_id", "lang")
              .withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= SAMPLE_DOCS)
              .select("doc_id", "lang").distinct())

    def passages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), as_strings(b.column(1)).to_pylist(), strict=True):
                data = letters(t)
                at = xxhash.xxh64_intdigest(str(i)) % max(1, len(data) - PASSAGE + 1)
                out.append(data[at:at + PASSAGE])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())],
                                             names=["doc_id", "lang", "passage"])

    rows = (train.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", F.col("text").cast("string"), "lang")
            .mapInArrow(passages, "doc_id long, lang string, passage binary")
            .groupBy("doc_id", "lang").agg(F.min("passage").alias("passage")).collect())
    out: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"])):
        out.setdefault(r["lang"], []).append(bytes(r["passage"]))
    return {lang: b"\n".join(p) for lang, p in out.items() if sum(map(len, p)) >= 8}


def letters(text: str) -> bytes:
    """The text in lower case, each run of other characters than letters a blank."""
    return _OTHERS.sub(" ", text.lower()).encode()


class Classifier:
    """Compressors of all languages; one of these in each task."""

    def __init__(self, content: dict[str, bytes]):
        self.langs = sorted(content)
        self.tools = []
        for lang in self.langs:
            made = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(dict_data=made, write_checksum=False, write_content_size=False))

    def predict(self, text: str) -> tuple[str, float, float, bool]:
        if not self.langs or not _LETTER.search(text):
            return "und", 0.0, 0.0, True
        data = letters(text)
        pieces = [data] if len(data) <= PIECE else [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
        size = np.array([sum(len(tool.compress(p)) for p in pieces) for tool in self.tools], dtype=float)
        best = int(size.argmin())
        if len(size) == 1:
            return self.langs[0], 1.0, 1.0, False
        second = np.partition(size, 1)[1]
        margin = float((second - size[best]) / second)
        # the odds that the lengths in bits stand for, tempered
        score = float(1 / np.exp2(-np.minimum(size - size[best], 500)).sum())
        return self.langs[best], score, margin, margin < MIN_MARGIN


def with_language(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """``docs`` with lang_pred, score, margin and rejected appended, from text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(content)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("struct<lang_pred: string, score: double, margin: double, rejected: boolean>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Classifier(shared.value)
        for batch in texts:
            rows = [model.predict(t.as_py()) for t in as_strings(batch)]
            yield pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(
                zip(*rows, strict=True) if rows else [[]] * 4, kind, strict=True)], fields=list(kind))

    rest = others(docs, *(f.name for f in kind))
    got = docs.withColumn("__lang", predict(F.col("text").cast("string")))
    return got.select(*rest, *(F.col(f"__lang.{f.name}").alias(f.name) for f in kind))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = dictionaries(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return with_language(docs.select("doc_id", "text"), content).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


QUERIES = {"op5_langid": (op5_langid, None)}
