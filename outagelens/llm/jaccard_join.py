"""N-gram Jaccard join by parity sketches: all texts whose shingle sets have a Jaccard similarity of 0.8 or more are linked.

A text's set are its distinct runs of five lower-cased words (all words, if fewer). Sets of a and b elements are similar if
their symmetric difference is (a + b) / 9 or less. Each element flips one bit of its text's sketch, so two sketches differ in
no more bits than the sets differ in elements. Texts are taken by size band, a doubling of the set size; a text near the top
of its band is also sketched for the next one. A band's long sketch is cut into blocks, one for two elements of the band's largest
sets, and a block is known by the XOR of its elements' 64-bit hashes (in the bands of small sets, each element is a block). By the pigeonhole
principle, of the blocks of one text at most as many as the allowed difference aren't found in the other. So if both list
their blocks from the rarest on, one more of them than that, they have one in common. Rarity is only an order: a table of hashed
counts over all texts, the same for every text; common lines stay out of the join by it.

Equal sets are one node. Nodes that share a listed block, and whose short sketches (some four bits an element) differ in no more bits than
allowed, are candidates; their sets are compared in full. Candidates are found inside tasks, in blocks of bounded size of a bucket's members, and
aren't all written: first each node gives its most similar one and, by two hashes, the ones of least hash; when these are compared, all candidates
of different components follow. So a component's inner pairs are left out, and nothing else. Components are found by alternating stars.

Edge cases: null and wordless texts have no shingles and are linked with nothing, each is its own component; rows that share a
doc_id are linked; rows without doc_id have no component; very long texts have longer sketches; equal rows are copies; an empty
table gives no rows; extra columns are ignored. Sets are compared by 64-bit hashes of their elements.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagelens.llm.common import as_strings, hash64, mix64, slices, split_words, stored, table, temporary, translated, window_hashes
from outagelens.llm.components import components
from outagelens.llm.near_dup import shingles
from outagelens.llm.quality import inside

SHINGLE = 5
#: similar: SHARE[0] * intersection >= SHARE[1] * union, that is 9 * difference <= sum of sizes
SHARE = 100, 80
#: buckets of the count table, and rows it is summed in
COUNTS, PARTS = 1 << 20, 64
#: bands whose largest sets have fewer elements than this have a block for each element
SMALL = 128
#: members of a block of a bucket; words of sketches compared at once; rows of a buffer
BLOCK, WORDS_AT_ONCE, BUFFER = 2048, 4_000_000, 20_000
#: bits of a table of wanted ids, by which rows are left out before a join (it may let others pass)
ID_BITS = 1 << 25

U = np.uint64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SIGNED = "at long, doc_id long, n long, s1 long, s2 long, bits binary, keys array<long>"


def _salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix64(x ^ mix64(np.array([salt], dtype=np.uint64)))


def _prepared(texts: pa.Array) -> pa.Array:
    return translated(as_strings(texts), LOWER)


def _summed(rows: DataFrame, size: int, kind: str, add, collect, finish) -> np.ndarray:
    """``collect(batches)`` gives an array of ``size`` for each task; all of them are put together by ``add``, in PARTS
    pieces, and go to the driver as ``finish(piece)`` of type ``kind``."""
    of = "part int, data binary"

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = collect(batches)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(
                [zlib.compress(x.tobytes(), 1) for x in np.split(total, PARTS)])], names=["part", "data"])

    def together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(zlib.decompress(data), dtype=kind)
                totals[part] = add(totals[part], x) if part in totals else x
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([finish(x).tobytes() for x in totals.values()])],
                                             names=["part", "data"])

    out = np.zeros((PARTS, size // PARTS), dtype=np.uint8)
    for r in rows.mapInArrow(own, of).repartition(PARTS, "part").mapInArrow(together, of).collect():  # ``size`` bytes
        out[r["part"]] = np.frombuffer(r["data"], dtype=np.uint8)
    return out.ravel()


def counted(docs: DataFrame) -> np.ndarray:
    """Rarity of each bucket of shingle hashes: eight times the binary logarithm of its count over all texts."""
    def collect(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(COUNTS, dtype=np.int64)
        for b in batches:
            texts = _prepared(b.column(0))
            for lo, hi in slices(texts):
                words = split_words(texts.slice(lo, hi - lo))
                runs = window_hashes(hash64(words.vocab)[words.ids], SHINGLE)[inside(words.doc_of(), SHINGLE)]
                total += np.bincount((runs % U(COUNTS)).astype(np.int64), minlength=COUNTS)
        return total

    return _summed(docs.select("text"), COUNTS, "<i8", np.add, collect,
                   lambda x: np.minimum(np.rint(8 * np.log2(x + 1.0)), 255).astype(np.uint8))


def _bit(ids: np.ndarray) -> np.ndarray:
    return (_salted(ids.view(np.uint64), 4) % U(ID_BITS)).astype(np.int64)


def id_filter(ids: DataFrame):
    """A column function that is true for all ids of ``ids`` (one column), and false for most others."""
    def collect(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        flags = np.zeros(ID_BITS, dtype=bool)
        for b in batches:
            flags[_bit(np.asarray(b.column(0)))] = True
        return np.packbits(flags)

    shared = ids.sparkSession.sparkContext.broadcast(_summed(ids, ID_BITS // 8, "u1", np.bitwise_or, collect, lambda x: x))

    @F.arrow_udf(T.BooleanType())
    def wanted(values: pa.Array) -> pa.Array:
        at = _bit(np.asarray(values.fill_null(0)))
        return pa.array((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    return wanted


def parity_bits(owner: np.ndarray, elements: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A parity sketch for each text: four bits for each element of its band's largest sets, 64 at least."""
    size = _bits(n)
    off = np.concatenate(([0], np.cumsum(size)))
    at = np.sort(off[owner] + (_salted(elements, 1) & (size[owner] - 1).astype(np.uint64)).astype(np.int64))
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    odd = np.diff(starts, append=len(at)) % 2 == 1
    flags = np.zeros(off[-1], dtype=bool)
    flags[at[starts[odd]]] = True
    packed = np.packbits(flags, bitorder="little")
    return [packed[a // 8:b // 8].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def _band(n: np.ndarray) -> np.ndarray:
    """b for set sizes from 2^(b-1) to 2^b - 1."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


def _bits(n: np.ndarray) -> np.ndarray:
    return np.maximum(64, 4 << _band(n))


def listed_blocks(owner: np.ndarray, elements: np.ndarray, rare: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the blocks that each text lists, for its own band and for the next one if it can have partners there."""
    band, most = _band(n), 5 * n // 4
    out_owner, out_key = [], []
    for step in (0, 1):
        b = band + step
        top = np.int64(1) << b
        on = (n > 0) & (most >= top >> 1) if step else n > 0
        for small in (True, False):
            mine = on & ((top < SMALL) == small)
            at = np.flatnonzero(mine[owner])
            if not len(at):
                continue
            who, value, rank = owner[at], elements[at], rare[at]
            if small:
                # |A \ B| is what counts for single elements: a fifth of A at most
                allowed, salt = n // 5, b[who].astype(np.uint64)
            else:
                allowed = (n + np.minimum(most, top - 1)) // 9
                block = (_salted(value, 2) & ((top >> 1) - 1)[who].astype(np.uint64)).astype(np.int64)
                order = np.lexsort((block, who))
                who, block = who[order], block[order]
                starts = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
                value, rank = np.bitwise_xor.reduceat(value[order], starts), np.minimum.reduceat(rank[order], starts)
                who = who[starts]
                salt = (block[starts].astype(np.uint64) + U(1)) << U(8) | b[who].astype(np.uint64)
            key = mix64(value + mix64(salt))
            order = np.lexsort((rank.astype(np.uint64) << U(56) | key >> U(8), who))
            who, key = who[order], key[order]
            first = np.flatnonzero(np.diff(who, prepend=-1))
            place = np.arange(len(who)) - np.repeat(first, np.diff(first, append=len(who)))
            some = place <= allowed[who]
            out_owner.append(who[some])
            out_key.append(key[some])
    owner, key = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_owner, out_key))
    order = np.argsort(owner, kind="stable")
    return owner[order], key[order].astype(np.uint64)


def signed(docs: DataFrame, rarity: np.ndarray) -> DataFrame:
    """A number for each row, set size, two hashes of the set, sketch and listed blocks; the last two for the first of a task's equal sets."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = _prepared(b.column(1))
            for lo, hi in slices(texts):
                owner, runs, _ = shingles(texts.slice(lo, hi - lo))
                n = np.bincount(owner, minlength=hi - lo)
                elements = mix64(runs)
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                s1, s2 = np.zeros((2, hi - lo), dtype=np.uint64)
                if len(first):
                    s1[n > 0] = np.bitwise_xor.reduceat(elements, first)
                    s2[n > 0] = np.add.reduceat(_salted(elements, 3), first)
                pairs = list(zip(s1.tolist(), s2.tolist(), strict=True))
                new = np.zeros(hi - lo, dtype=bool)
                named = np.asarray(b.column(0).slice(lo, hi - lo).is_valid())
                for i in np.flatnonzero((n > 0) & named).tolist():
                    if pairs[i] not in seen:
                        new[i] = True
                        seen.add(pairs[i])
                on = new[owner]
                place = np.cumsum(new) - 1
                who, elements, size = place[owner[on]], elements[on], n[new]
                rare = shared.value[(runs[on] % U(COUNTS)).astype(np.int64)]
                of, keys = listed_blocks(who, elements, rare, size)
                bits: list = [None] * (hi - lo)
                for i, x in zip(np.flatnonzero(new).tolist(), parity_bits(who, elements, size), strict=True):
                    bits[i] = x
                counts = np.zeros(hi - lo, dtype=np.int64)
                counts[new] = np.bincount(of, minlength=len(size))
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(at, at + hi - lo)), b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(bits, pa.binary()),
                     pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64)), mask=pa.array(~new))],
                    names=["at", "doc_id", "n", "s1", "s2", "bits", "keys"])
                at += hi - lo

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sign, SIGNED)


def _whole(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole groups of ``keys``, BUFFER rows or a group each."""
    rest, held = [], 0
    for b in batches:
        rest.append(b)
        held += b.num_rows
        if held < BUFFER:
            continue
        t = pa.Table.from_batches(rest)
        k = np.stack([np.asarray(t.column(c)) for c in keys])
        change = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0))
        if len(change):
            cut = int(change[-1]) + 1
            yield t.slice(0, cut)
            t = t.slice(cut)
        rest, held = t.to_batches(), t.num_rows
    if held:
        yield pa.Table.from_batches(rest)


def _folded(bits: list[bytes], size: int) -> np.ndarray:
    """Sketches of ``size`` bits, as rows of 64-bit words, from ones of that or twice that size."""
    rows = np.zeros((len(bits), size // 64), dtype=np.uint64)
    for i, x in enumerate(bits):
        w = np.frombuffer(x, dtype="<u8")
        rows[i] = w if len(w) * 64 == size else w[:size // 64] ^ w[size // 64:]
    return rows


def alike(group: np.ndarray, part: np.ndarray, both: np.ndarray, n: np.ndarray, bits: list[bytes],
          apart: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of a group's members that may be similar by size and sketch, and by how much of the sizes' sum they differ.

    ``both``: only members of different ``part`` meet; ``apart``: only members in which this differs."""
    order = np.lexsort((n, group))
    place = group[order] << 40
    last = np.searchsorted(place + n[order], place + 5 * n[order] // 4, side="right")
    many = np.maximum(last - np.arange(len(order)) - 1, 0)
    ends = np.cumsum(many)
    size = _bits(n)
    rows = {s: np.flatnonzero((size == s) | (size == 2 * s)) for s in np.unique(size).tolist()}
    sketch = {s: (_folded([bits[i] for i in at.tolist()], s), at) for s, at in rows.items()}
    found = [np.zeros((3, 0))]
    step = max(1, WORDS_AT_ONCE // max(int(size.max()) // 64, 1))
    for lo in range(0, int(ends[-1]) if len(ends) else 0, step):
        p = np.arange(lo, min(lo + step, int(ends[-1])))
        i = np.searchsorted(ends, p, side="right")
        j = i + 1 + (p - (ends[i] - many[i]))
        i, j = order[i], order[j]
        on = ~both[i] | (part[i] != part[j])
        if apart is not None:
            on &= apart[i] != apart[j]
        i, j = i[on], j[on]
        short = np.minimum(size[i], size[j])
        for s in np.unique(short).tolist():
            at = short == s
            words, has = sketch[s]
            a, b = np.searchsorted(has, i[at]), np.searchsorted(has, j[at])
            differ = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
            total = n[i[at]] + n[j[at]]
            near = 9 * differ <= total
            found.append(np.stack((i[at][near], j[at][near], differ[near] / total[near])))
    i, j, share = np.concatenate(found, axis=1)
    return i.astype(np.int64), j.astype(np.int64), share


def _firsts(order_by: list[np.ndarray], owner: list[np.ndarray], most: int) -> np.ndarray:
    """Indices of the first ``most`` rows of each owner in the given order."""
    order = np.lexsort((*order_by[::-1], *owner[::-1]))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for o in owner:
        new[1:] |= o[order][1:] != o[order][:-1]
    first = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    return order[place < most]


def _proposed(batches: Iterable[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b) of blocks: ``first`` some of each member, then all of different components."""
    keys = ["key", "lb", "rb"]
    for t in _whole(batches, keys):
        k = np.stack([np.asarray(t.column(c)) for c in keys])
        group = np.cumsum(np.concatenate(([0], (k[:, 1:] != k[:, :-1]).any(axis=0)))).astype(np.int64)
        rep, cls, n, part = (np.asarray(t.column(c)) for c in ("rep", "class", "n", "part"))
        i, j, share = alike(group, part, k[1] != k[2], n, t.column("bits").to_pylist(), cls)
        if not len(i):
            continue
        if first:
            me, other = np.concatenate((i, j)), np.concatenate((j, i))
            orders = [np.concatenate((share, share)), *(_salted(rep[other].view(np.uint64), salt) for salt in (5, 6))]
            some = np.unique(np.concatenate([_firsts([o], [rep[me]], 1) for o in orders]) % len(i))
            i, j = i[some], j[some]
        pairs = np.unique(np.sort(np.stack((rep[i], rep[j])), axis=0), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["a", "b"])


@F.arrow_udf(T.BooleanType())
def similar(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether the texts' sets are similar, from all their shingles."""
    n = len(a)
    a, b = _prepared(a), _prepared(b)
    out = np.zeros(n, dtype=bool)
    for lo, hi in slices(a):
        rows = [shingles(x.slice(lo, hi - lo))[:2] for x in (a, b)]
        cut = [np.searchsorted(o, np.arange(hi - lo + 1)) for o, _ in rows]
        for i in range(hi - lo):
            x, y = (r[c[i]:c[i + 1]] for (_, r), c in zip(rows, cut, strict=True))
            both = len(np.intersect1d(x, y, assume_unique=True))
            out[lo + i] = bool(both) and SHARE[0] * both >= SHARE[1] * (len(x) + len(y) - both)
    return pa.array(out)


def texts_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts (rep, text) of ``docs`` that are in one of ``pairs`` (a, b): other texts are neither shuffled nor written."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "join-paired")
    paired = id_filter(wanted)
    return stored(docs.where("doc_id is not null").where(paired("doc_id")).withColumnRenamed("doc_id", "rep").join(wanted.hint("merge"), "rep")
                  .groupBy("rep", F.xxhash64("text")).agg(F.first("text").alias("text")).select("rep", "text"), "join-texts")


def compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs`` (a, b; distinct) with whether they are linked, from their whole texts in ``docs``."""
    texts = texts_of(pairs, docs)
    # merged at every size: what is shuffled then follows the input
    one = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    two = one.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    return stored(two.select("a", "b", similar("ta", "tb").alias("linked")), "join-compared")


def proposed(buckets: DataFrame, sketches: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Candidate pairs of ``buckets`` (key, rep, members); with ``classes`` (rep, class) all of different ones."""
    if classes is None:
        rows = buckets.withColumn("class", F.col("rep"))
    else:
        every = Window.partitionBy("key")
        rows = buckets.join(classes, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
        rows = rows.withColumn("mixed", F.min("class").over(every) != F.max("class").over(every)).where("mixed")
    # a large bucket is dealt to blocks, each of two of its parts
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("key", F.least("part", "other").alias("lb"), F.greatest("part", "other").alias("rb"), "part", "rep", "class").join(sketches.hint("merge"), "rep")
    keys, first = ["key", "lb", "rb"], classes is None
    found = (rows.select(*keys, "part", "rep", "class", "n", "bits").repartition(*keys).sortWithinPartitions(*keys)
             .mapInArrow(lambda b: _proposed(b, first), "a long, b long"))
    return found.distinct()


def linked_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    with temporary(docs.sparkSession):
        return stored(_linked_components(docs), "join-result", keep=True)


def _linked_components(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # joins are merged at every size: what is shuffled then follows the input
    info = stored(signed(docs, counted(docs)), "join-signed")
    own = info.where("n > 0 and doc_id is not null")
    # a row for each set; ``at`` is a row of ``info`` with its sketch
    sets = stored(own.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.min(F.when(F.col("bits").isNotNull(), F.col("at"))).alias("at")),
                  "join-sets")
    # blocks that different sets list, with their number and a hash of them; of buckets with the same members one is enough
    at, ordered = Window.partitionBy("key"), Window.partitionBy("key").orderBy("s1")
    fresh = F.col("before").isNull() | (F.col("before") != F.col("s1"))
    rows = info.where("keys is not null").select(F.explode("keys").alias("key"), "s1")
    shared = (rows.repartition("key").sortWithinPartitions("key", "s1").withColumn("before", F.lag("s1").over(ordered)).where(fresh)
              .select("key", "s1", F.count("*").over(at).alias("members"), F.bit_xor(F.xxhash64("s1")).over(at).alias("x"),
                      F.bit_xor(F.xxhash64(F.lit(1), "s1")).over(at).alias("y")).where("members > 1"))
    shared = shared.groupBy("s1", "members", "x", "y").agg(F.min("key").alias("key"))
    buckets = stored(shared.join(sets.select("s1", "rep").hint("merge"), "s1").select("key", "rep", "members"), "join-buckets")
    wanted = stored(sets.join(buckets.select("rep").hint("merge"), "rep", "left_semi").select("rep", "n", "at"), "join-wanted")
    has_sketch = id_filter(wanted.where("at is not null").select("at"))
    sketches = stored(info.where("bits is not null").select("at", "bits").where(has_sketch("at")).join(wanted.hint("merge"), "at").select("rep", "n", "bits"), "join-sketches")
    links = _same_id(own, sets)
    pairs = stored(proposed(buckets, sketches, None), "join-pairs")
    found = compared(pairs, docs)
    links = links.unionByName(found.where("linked").select("a", "b"))
    classes = components(links).withColumnRenamed("node", "rep")
    pairs = stored(proposed(buckets, sketches, classes).join(pairs, ["a", "b"], "left_anti"), "join-pairs")
    if not pairs.isEmpty():
        more = compared(pairs, docs).where("linked").select("a", "b")
        # the classes so far, as stars, and the new links
        classes = components(classes.select(F.col("rep").alias("a"), F.col("class").alias("b")).unionByName(more)).withColumnRenamed("node", "rep")
    named = stored(sets.join(classes.hint("merge"), "rep", "left").select("n", "s1", "s2", F.coalesce("class", "rep").alias("component")), "join-named")
    return info.select("doc_id", "n", "s1", "s2").join(named.hint("merge"), ["n", "s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _same_id(own: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of rows that share a doc_id."""
    twice = stored(own.groupBy("doc_id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("doc_id"), "join-twice")
    if twice.isEmpty():
        return own.sparkSession.createDataFrame([], "a long, b long")
    of = own.join(twice, "doc_id", "left_semi").select("doc_id", "n", "s1", "s2").distinct().join(sets, ["n", "s1", "s2"]).select("doc_id", "rep")
    return stored(of.join(of.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")), "join-same")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op13_jaccard_join": (op13_jaccard_join, None)}
