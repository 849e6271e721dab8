"""WARC archives of pages and a two-level capture index over them.

Archives: WARC/1.1 files, a record for each page. Of pages with equal payloads of ``MIN_REVISIT`` bytes or more, that
with the largest page_id is a response, the others are revisits that refer to it; shorter payloads are all responses.
Records are written as text by Spark (payloads are UTF-8), so any file system that Spark can write will do, and lost
tasks are repeated. Files aren't compressed, so a record is a byte range.

Index: the first level is one line for each record, sorted by the key of its URL (host labels reversed, then path and
query), in zlib-compressed blocks of ``BLOCK_LINES``; the second level, the directory, has each block's first and last
key. A lookup finds the key's blocks by binary search of the directory, one block is decompressed and searched, and
the record is read by its byte range; the query looks up the URLs of all pages so, in tasks.

Edge cases: a null html is an empty payload, a null URL an empty key; null page_ids are written as -1 and come back null;
all rows that share the largest page_id of a payload are responses; no pages give no archives and an empty index.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outagelens.llm.common import scratch_path, stored, table

MIN_REVISIT = 1000
BLOCK_LINES = 3000
#: records of one archive file at most; a reading task holds one file
FILE_RECORDS = 2000
DATE = "2024-01-01T00:00:00Z"
SEPARATOR = "\t"


def reversed_host_key(url: str | None) -> str:
    """``com,example,www)/path?query`` for ``http://www.example.com:80/path?query#part``; host in lower case."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").strip()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def index_key(url: str | None) -> str:
    """The key under which the index lists a URL's records: of the URL as a record's field holds it, without separators."""
    return reversed_host_key(re.sub(r"[\r\n]", " ", url or "")).translate({9: 32, 10: 32})


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, html, bytes, digest and refers_to (null: response) of every page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    # one row for each task and payload goes into the shuffle; written, so that the join may split hot payloads
    first = stored(own.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest", "bytes")
                   .agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("digest", "bytes", "response"),
                   "payloads")
    marks = stored(own.select("page_id", "digest", "bytes").join(first, ["digest", "bytes"])
                   .where("page_id is null or page_id <> response").groupBy("page_id", "digest").agg(F.max("response").alias("refers_to")),
                   "revisits")
    return own.join(marks.withColumnsRenamed({"page_id": "__id", "digest": "__digest"}),
                    F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left").drop("__id", "__digest")


def write_archives(pages: DataFrame, path: str) -> None:
    """A WARC record for each page, in text files of FILE_RECORDS records at most."""
    rows = decided(pages)
    crlf = "\r\n"
    revisit = F.col("refers_to").isNotNull()
    # a revisit has no payload of its own; its fields tell the payload's digest and length
    body = F.when(revisit, "").otherwise(F.col("html"))
    head = F.concat(F.lit("WARC/1.1" + crlf + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
                    F.lit(crlf + "WARC-Record-ID: <urn:page:"), F.coalesce("page_id", F.lit(-1)).cast("string"),
                    F.lit(">" + crlf + "WARC-Date: " + DATE + crlf + "WARC-Target-URI: "),
                    F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " "),
                    F.lit(crlf + "WARC-Payload-Digest: sha1:"), F.col("digest"),
                    F.lit(crlf + "WARC-Payload-Length: "), F.col("bytes").cast("string"),
                    F.when(revisit, F.concat(F.lit(crlf + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                                                   + crlf + "WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))
                    .otherwise(""),
                    F.lit(crlf + "Content-Type: text/html" + crlf + "Content-Length: "),
                    F.octet_length(body).cast("string"), F.lit(crlf + crlf))
    # the writer ends each record with the last of its line feeds
    (rows.select(F.concat(head, body, F.lit(crlf + "\r")).alias("value")).write
     .option("lineSep", "\n").option("maxRecordsPerFile", FILE_RECORDS).text(path))


def parsed(data: bytes | memoryview) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """Offset, length, fields and payload of each record of a file (or of a range of it that begins with a record)."""
    view, at = memoryview(data), 0
    whole = bytes(data)
    while at < len(whole):
        end = whole.index(b"\r\n\r\n", at) + 4
        fields = dict(line.split(": ", 1) for line in whole[at:end - 4].decode().split("\r\n")[1:])
        stop = end + int(fields["Content-Length"])
        yield at, stop + 4 - at, fields, view[end:stop]
        at = stop + 4


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """An index line's fields for every record of the archives."""
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(reversed_host_key(f["WARC-Target-URI"]), file, at, n) for at, n, f, _ in parsed(content.as_buffer())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                    zip(*rows, strict=True) if rows else [[]] * 4, [pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True)],
                    names=["key", "file", "offset", "length"])

    return _files(spark, path).mapInArrow(read, "key string, file string, offset long, length long")


def write_index(spark: SparkSession, archives: str, path: str) -> None:
    """``path``/blocks: first key, last key and the compressed lines of each block; ``path``/directory: without the lines."""
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, rows = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            text = "\n".join(SEPARATOR.join(map(str, r)) for r in rows)
            return pa.RecordBatch.from_arrays([
                pa.array([rows[0][0]]), pa.array([rows[-1][0]]), pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                pa.array([zlib.compress(text.encode())], pa.binary())], names=["first_key", "last_key", "part", "block", "lines"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.append(r)
                if len(rows) == BLOCK_LINES:
                    yield block()
                    rows, number = [], number + 1
        if rows:
            yield block()

    # file and offset split a key with very many captures
    by = ["key", "file", "offset"]
    (captures(spark, archives).withColumn("key", F.translate("key", "\t\n", "  ")).repartitionByRange(*by)
     .sortWithinPartitions(*by).mapInArrow(pack, "first_key string, last_key string, part int, block int, lines binary")
     .write.parquet(f"{path}/blocks"))
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks.drop("lines").write.parquet(f"{path}/directory")


def lines_of(block: bytes) -> list[tuple[str, str, int, int]]:
    """key, file, offset and length of each line of a block."""
    rows = (x.split(SEPARATOR) for x in zlib.decompress(block).decode().split("\n"))
    return [(key, file, int(at), int(n)) for key, file, at, n in rows]


def lines_with(lines: list[tuple[str, str, int, int]], key: str) -> Iterator[tuple[str, str, int, int]]:
    """The lines of a key, by binary search."""
    i = bisect_left(lines, (key,))
    while i < len(lines) and lines[i][0] == key:
        yield lines[i]
        i += 1


def _directory(spark: SparkSession, path: str) -> list[tuple[str, str, int, int]]:
    """First key, last key, part and block of every block, in order."""
    return [tuple(r) for r in spark.read.parquet(f"{path}/directory").orderBy("first_key", "part", "block").collect()]


def _holders(directory: list[tuple[str, str, int, int]], last: list[str], key: str) -> Iterator[tuple[int, int]]:
    """(part, block) of the blocks that may hold the key, by binary search of their last keys."""
    at = bisect_left(last, key)  # the first block that doesn't end before the key
    while at < len(directory) and directory[at][0] <= key:
        yield directory[at][2:]
        at += 1


class CaptureIndex:
    """Lookups of single URLs: the directory, a row for BLOCK_LINES records, is held sorted; blocks are read when they are needed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.blocks = spark, spark.read.parquet(f"{path}/blocks")
        self.directory = _directory(spark, path)
        self.last = [r[1] for r in self.directory]

    def lookup(self, url: str) -> list[tuple[str, str, int, int]]:
        """The URL's index lines."""
        key, out = index_key(url), []
        for part, block in _holders(self.directory, self.last, key):
            found = self.blocks.where((F.col("part") == part) & (F.col("block") == block)).select("lines").first()
            out += lines_with(lines_of(bytes(found[0])), key)
        return out

    def read(self, line: tuple[str, str, int, int]) -> tuple[dict[str, str], bytes]:
        """Fields and payload of a line's record, by a read of its byte range."""
        _, file, offset, length = line
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(file)
        stream = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(path)
        try:
            stream.seek(offset)
            data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
        finally:
            stream.close()
        _, _, fields, payload = next(parsed(data))
        return fields, bytes(payload)


def _opened(path: str) -> pa.NativeFile:
    """An archive, open for reads of byte ranges by tasks: local or mounted folders and the stores that Arrow reads (HDFS, S3, GCS)."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return store.open_input_file(name)


def _lines_batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    files, at, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(files), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["path", "offset", "length"])


def lookups(spark: SparkSession, index: str, urls: DataFrame) -> DataFrame:
    """path, offset and length of the index lines of every URL of ``urls`` (column url), each line once.

    Tasks search the directory (broadcast, a row for BLOCK_LINES records) for the blocks that may hold a key; a block
    meets its keys by a join, is decompressed once and searched."""
    directory = _directory(spark, index)
    shared = spark.sparkContext.broadcast((directory, [r[1] for r in directory]))

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({index_key(u) for u in b.column(0).to_pylist()}), pa.string())], names=["key"])

    def blocks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = shared.value
        for b in batches:
            found = [(part, block, key) for key in b.column(0).to_pylist() for part, block in _holders(rows, last, key)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                zip(*found, strict=True) if found else [[]] * 3, [pa.int32(), pa.int32(), pa.string()], strict=True)], names=["part", "block", "key"])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed, wanted in zip(b.column(0), b.column(1), strict=True):
                lines = lines_of(packed.as_py())
                found = [line[1:] for key in wanted.as_py() for line in lines_with(lines, key)]
                if found:
                    yield _lines_batch(found)

    wanted = (urls.select(F.col("url").cast("string")).mapInArrow(keys, "key string").distinct()
              .mapInArrow(blocks_of, "part int, block int, key string").groupBy("part", "block").agg(F.collect_list("key").alias("keys")))
    return (spark.read.parquet(f"{index}/blocks").join(wanted, ["part", "block"]).select("lines", "keys")
            .mapInArrow(search, "path string, offset long, length long"))


def read_captures(spark: SparkSession, archives: str, index: str, urls: DataFrame | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records of all ``urls`` (without it, of every
    record that the index lists).

    Lines are dealt by file; a task reads each record by its byte range, so no payload is shuffled and nothing else of
    ``archives`` is read."""
    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column(0).to_pylist():
                yield _lines_batch([line[1:] for line in lines_of(block)])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: int(urn[len("<urn:page:"):-1])
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        at, file = None, None
        for b in batches:
            rows = []
            for path, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if path != at:
                    if file is not None:
                        file.close()
                    at, file = path, _opened(path)
                _, n, f, payload = next(parsed(file.read_at(length, offset)))
                kind, size = f["WARC-Type"], int(f["WARC-Payload-Length"])
                digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                if n != length or kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                    raise ValueError(f"record {f['WARC-Record-ID']} is damaged")
                page = number(f["WARC-Record-ID"])
                rows.append((None if page == -1 else page, size, digest, kind, number(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if file is not None:
            file.close()

    if urls is None:
        listed = spark.read.parquet(f"{index}/blocks").select("lines").mapInArrow(expand, "path string, offset long, length long")
    else:
        listed = lookups(spark, index, urls)
    # a fixed number: lines are few bytes, the records they stand for are not, so Spark would merge too many into a task
    tasks = max(1, spark.read.parquet(f"{index}/directory").count() // 2)
    return (listed.repartition(tasks, "path").sortWithinPartitions("path", "offset").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, index = scratch_path(spark, "warc"), scratch_path(spark, "captures")
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, archives)
    write_index(spark, archives, index)
    return read_captures(spark, archives, index, pages.select("url"))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM r
"""

QUERIES = {"op10_warc": (op10_warc, SQL)}
