"""MinHash near-dedup by ProbMinHash: signatures of weighted word shingles, banding, verification, classes.

A text's shingles are its runs of five words (all words, if fewer) weighted by how often they occur. Each shingle
is a Poisson process with its weight as the rate: arrivals at exponential distances, each for a random one of
``REGISTERS`` registers, which keeps the shingle that arrives first. Two texts agree in a register with the probability
Jaccard of their weights. A text in which shingles repeat is signed a second time with all weights 1, so in that plain
signature texts agree with their plain Jaccard; elsewhere both signatures are the same. Arrivals later than a bound by which
nearly always all registers are filled aren't made; texts with an empty register go on with a doubled bound.

Exact copies are one text with one representative. Texts equal in a band of ``ROWS`` registers, of either signature, are
candidates. In
each band's bucket, all members are compared with one, chosen by a hash of band and id; then, in buckets whose members
are in several classes, those outside the largest class with all of other classes that agree in ``LEAST`` registers of either signature;
that is done in blocks of a bucket, within tasks, so pairs aren't rows. Candidates are
linked if probability Jaccard or plain Jaccard of their shingles, from their texts, is ``SIMILARITY`` or more. Classes
are connected components, found by alternating stars; a class's id is its smallest doc_id.

Edge cases: null and wordless texts are never similar to anything (not even to each other); rows with null doc_id get a
null class; rows that share a doc_id are one document (the one with the smallest text hash counts); empty tables work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagelens.llm.common import as_strings, hash64, mix64, slices, split_words, stored, table, temporary, window_hashes
from outagelens.llm.components import components
from outagelens.llm.quality import inside

SHINGLE = 5
SIMILARITY = 0.8
#: 28 bands of 4: texts of similarity 0.8, by either measure, share a band with probability 1 - 4e-7, and about 11 bands
BANDS, ROWS = 28, 4
REGISTERS = BANDS * ROWS
#: of REGISTERS; at similarity 0.8 fewer agree with probability 3e-5, and then other bands' leaders are left
LEAST = 72
#: strays and members of a block of a bucket
BLOCK = 2048
#: candidates for each row of a block, beyond which they are verified in its task
DENSE = 4
#: candidates of a dense block that are looked through at once
AT_ONCE = 1024

U = np.uint64


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of each distinct shingle, sorted by text and hash."""
    words = split_words(texts)
    doc = words.doc_of()
    h = hash64(words.vocab)[words.ids]
    ok = inside(doc, SHINGLE)
    runs, owner = window_hashes(h, SHINGLE)[ok], doc[:len(ok)][ok]
    n = np.diff(words.starts)
    for d in np.flatnonzero((n > 0) & (n < SHINGLE)):
        s = words.starts[d]
        runs = np.append(runs, window_hashes(h[s:s + n[d]], int(n[d])))
        owner = np.append(owner, d)
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1]))) if len(runs) else [])
    return owner[first], runs[first], np.diff(np.append(first, len(runs)))


def signatures(owner: np.ndarray, runs: np.ndarray, weight: np.ndarray, n_texts: int) -> np.ndarray:
    """A row of REGISTERS shingle hashes for each text (zeros for a text without shingles)."""
    out = np.zeros((n_texts, REGISTERS), dtype=np.uint64)
    total = np.bincount(owner, weights=weight, minlength=n_texts)
    with np.errstate(divide="ignore"):
        bound = REGISTERS / total * (np.log(REGISTERS) + 3)
    left = total > 0
    while left.any():
        mine = np.flatnonzero(left[owner])
        time, seed = np.zeros(len(mine)), runs[mine].copy()
        best = np.full(n_texts * REGISTERS, np.inf)
        who = np.zeros(n_texts * REGISTERS, dtype=np.uint64)
        while len(mine):
            seed = mix64(seed + U(0x9E3779B97F4A7C15))
            time = time - np.log(((seed >> U(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight[mine]
            on = time < bound[owner[mine]]
            mine, time, seed = mine[on], time[on], seed[on]
            slot = owner[mine] * REGISTERS + (mix64(seed ^ U(0xD6E8FEB86659FD93)) % U(REGISTERS)).astype(np.int64)
            late = np.argsort(-time, kind="stable")  # of several arrivals the last one written is the earliest
            sooner = late[time[late] < best[slot[late]]]
            best[slot[sooner]], who[slot[sooner]] = time[sooner], runs[mine[sooner]]
        full = left & np.isfinite(best.reshape(n_texts, REGISTERS)).all(axis=1)
        out[full] = who.reshape(n_texts, REGISTERS)[full]
        left &= ~full
        bound = bound * 2
    return out


def both_signatures(owner: np.ndarray, runs: np.ndarray, weight: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures by weight, signatures with all weights 1, and the texts in which these differ as shingles repeat."""
    sig = signatures(owner, runs, weight, n_texts)
    repeats = np.bincount(owner, weights=weight > 1, minlength=n_texts) > 0
    plain, on = sig.copy(), repeats[owner]
    if repeats.any():
        place = np.cumsum(repeats) - 1
        plain[repeats] = signatures(place[owner[on]], runs[on], np.ones(int(on.sum())), int(repeats.sum()))
    return sig, plain, repeats


def band_hashes(sig: np.ndarray) -> np.ndarray:
    acc = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        acc = mix64(acc + sig[:, r::ROWS])
    return acc


SIGNED = (T.StructType().add("wordy", T.BooleanType()).add("sig", T.ArrayType(T.IntegerType())).add("plain", T.ArrayType(T.IntegerType()))
          .add("bands", T.ArrayType(T.LongType())))


@F.arrow_udf(SIGNED)
def signed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Signature (32 bits of each register), plain signature where it differs, and band hashes of each text (those of the plain
    signature follow where it differs); wordy: it has a shingle."""
    for batch in texts:
        batch = as_strings(batch)
        parts = [(np.zeros((0, REGISTERS), np.uint64), np.zeros((0, REGISTERS), np.uint64), np.zeros(0, bool), np.zeros(0, bool))]
        for lo, hi in slices(batch):
            owner, runs, weight = shingles(batch.slice(lo, hi - lo))
            parts.append((*both_signatures(owner, runs, weight, hi - lo), np.bincount(owner, minlength=hi - lo) > 0))
        sig, plain, repeats, has = (np.concatenate(x) for x in zip(*parts, strict=True))
        bands = np.stack((band_hashes(sig), band_hashes(plain)), axis=1).view(np.int64)
        used = np.stack((np.ones(len(sig), bool), repeats), axis=1)
        ends = lambda n: np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        low = lambda x: pa.array(x.astype(np.uint32).view(np.int32).ravel())
        yield pa.StructArray.from_arrays([
            pa.array(has), pa.ListArray.from_arrays(ends(np.full(len(sig), REGISTERS)), low(sig)),
            pa.ListArray.from_arrays(ends(REGISTERS * repeats), low(plain[repeats]), mask=pa.array(~repeats)),
            pa.ListArray.from_arrays(ends(BANDS * used.sum(axis=1)), pa.array(bands[used].ravel()))],
            names=["wordy", "sig", "plain", "bands"])


@F.arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """The larger of probability Jaccard and plain Jaccard of the texts' shingles."""
    n = len(a)
    a, b = as_strings(a), as_strings(b)
    out = np.zeros(n)
    for lo, hi in slices(a):
        rows = [shingles(x.slice(lo, hi - lo)) for x in (a, b)]
        cut = [np.searchsorted(o, np.arange(hi - lo + 1)) for o, _, _ in rows]
        for i in range(hi - lo):
            out[lo + i] = likeness(*(v[c[i]:c[i + 1]] for (_, r, w), c in zip(rows, cut, strict=True) for v in (r, w)))
    return pa.array(out)


def likeness(ra: np.ndarray, wa: np.ndarray, rb: np.ndarray, wb: np.ndarray) -> float:
    """The similarity of two texts from their shingles and weights."""
    both, ia, ib = np.intersect1d(ra, rb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    plain = len(both) / (len(ra) + len(rb) - len(both))
    # without repeats both measures are the same
    if plain >= SIMILARITY or wa.max() == wb.max() == 1:
        return plain
    return max(plain, probability_jaccard(wa, wb, ia, ib))


def probability_jaccard(wa: np.ndarray, wb: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> float:
    """Sum over common d of 1 / sum over all i of max(a_i / a_d, b_i / b_d); ia, ib: where the common ones are."""
    a, b = np.concatenate((wa, np.zeros(len(wb) - len(ib)))), np.zeros(len(wa) + len(wb) - len(ib))
    b[ia] = wb[ib]
    alone = np.ones(len(wb), dtype=bool)
    alone[ib] = False
    b[len(wa):] = wb[alone]
    # in the order of a_i / b_i, the maximum is a_i / a_d from d's place on and b_i / b_d before it
    with np.errstate(divide="ignore", invalid="ignore"):
        order = np.argsort(a / b)
    a, b = a[order], b[order]
    sum_a, sum_b = np.concatenate((np.cumsum(a[::-1])[::-1], [0])), np.concatenate(([0], np.cumsum(b)))
    at = np.searchsorted((a / np.maximum(b, 1e-300)), wa[ia] / wb[ib])
    total = np.sum(1 / (sum_a[at] / wa[ia] + sum_b[at] / wb[ib]))
    return float(total)


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b; distinct) whose texts (rep, text) are similar."""
    # merged at every size: what is shuffled then follows the input
    one = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    two = one.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    return stored(two.withColumn("similarity", similarity("ta", "tb")).where(F.col("similarity") >= SIMILARITY)
                  .select("a", "b").distinct(), "verified")


def agreeing(left: tuple, right: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of texts that agree in LEAST registers of a signature and in no band before band k, and in how many
    registers; left, right: signatures, plain signatures, and whether these differ."""
    out = [np.zeros((3, 0), dtype=np.int64)]
    (sigs, plains, repeats), (sig_r, plain_r, repeat_r) = left, right
    some = np.flatnonzero(repeat_r)
    for i, (sig, plain, own) in enumerate(zip(sigs, plains, repeats, strict=True)):
        n = (sig_r == sig).sum(axis=1)
        # where neither text repeats a shingle, the plain signatures are the same
        rows = slice(None) if own else some
        n[rows] = np.maximum(n[rows], (plain_r[rows] == plain).sum(axis=1))
        j = np.flatnonzero(n >= LEAST)
        if not len(j):
            continue
        # the buckets in which both are: any signature of one and any of the other
        shared = np.zeros((len(j), BANDS), bool)
        for a in (sig, plain) if own else (sig,):
            for b in (sig_r, plain_r) if repeat_r[j].any() else (sig_r,):
                shared |= (b[j] == a).reshape(len(j), BANDS, ROWS).all(axis=2)
        j = j[shared.argmax(axis=1) == k]
        out.append(np.stack((np.full(len(j), i), j, n[j])))
    return tuple(np.concatenate(out, axis=1))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows sorted by (band, lb, rb), block by block."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        key = np.stack([np.asarray(t.column(c)) for c in ("band", "lb", "rb")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield tuple(key[:, lo].tolist()), t.slice(lo, hi - lo)
        rest = t.slice(cuts[-1]) if len(t) else None
    if rest is not None and len(rest):
        yield tuple(rest.column(c)[0].as_py() for c in ("band", "lb", "rb")), rest


def _sides(t: pa.Table) -> tuple:
    """Of a block: rep, class and signatures of strays (left) and members (right), and the band's number."""
    rep, cls, left = (np.asarray(t.column(c)) for c in ("rep", "class", "left"))
    sig = np.asarray(t.column("sig").combine_chunks().flatten()).reshape(-1, REGISTERS)
    repeats = np.asarray(t.column("plain").is_valid())
    plain = sig.copy()
    plain[repeats] = np.asarray(t.column("plain").combine_chunks().flatten()).reshape(-1, REGISTERS)
    lo, hi = np.flatnonzero(left), np.flatnonzero(~left)
    return rep, cls, (sig, plain, repeats), lo, hi, t.column("k")[0].as_py()


def _candidates(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rep, cls, signs, lo, hi, k = _sides(t)
    i, j, n = agreeing(*(tuple(x[at] for x in signs) for at in (lo, hi)), k)
    i, j = lo[i], hi[j]
    on = cls[i] != cls[j]
    return rep, cls, i[on], j[on], n[on]


def _few(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b) of blocks with ``most`` for each row; the keys (band, lb, rb) of the others, which are dense."""
    names = ["a", "b", "band", "lb", "rb"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    rows: list[tuple] = []
    for key, t in _blocks(batches):
        rep, _, i, j, _ = _candidates(t)
        if len(i) > most * len(rep):
            rows.append((None, None, *key))
        else:
            rows += [(min(x, y), max(x, y), None, None, None) for x, y in zip(rep[i].tolist(), rep[j].tolist(), strict=True)]
        if len(rows) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of dense blocks: candidates are verified here, the most alike first, unless their classes have met."""
    for _, t in _blocks(batches):
        rep, cls, i, j, n = _candidates(t)
        owner, runs, weight = shingles(as_strings(t.column("text")))
        cut = np.searchsorted(owner, np.arange(len(rep) + 1))
        part, links = np.unique(cls, return_inverse=True)[1], []
        order = np.argsort(-n, kind="stable")
        for lo in range(0, len(order), AT_ONCE):
            some = order[lo:lo + AT_ONCE]
            for x, y in zip(*(v[some[part[i[some]] != part[j[some]]]].tolist() for v in (i, j)), strict=True):
                if part[x] != part[y] and likeness(*(v[cut[z]:cut[z + 1]] for z in (x, y) for v in (runs, weight))) >= SIMILARITY:
                    part[part == part[x]] = part[y]
                    links.append(sorted((int(rep[x]), int(rep[y]))))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])


def stray_links(members: DataFrame, reps: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between members of different classes of a bucket, one of them outside the bucket's largest class.

    ``members``: band, k, rep, class, main (the largest class); ``reps``: rep, sig, plain. A bucket's strays and members meet in
    blocks of about BLOCK each; the pairs of a block stay in its task, but for the few that may be similar. Where those
    aren't few, the block gets the texts and only links come out."""
    side = members.withColumn("stray", F.col("class") != F.col("main"))
    size = side.groupBy("band").agg(F.count("*").alias("n"), F.count(F.when(F.col("stray"), 1)).alias("s"))
    side = side.join(stored(size, "bucket-sizes"), "band").select(
        "band", "k", "rep", "class", "stray", F.ceil(F.col("s") / BLOCK).cast("int").alias("nl"), F.ceil(F.col("n") / BLOCK).cast("int").alias("nr"))
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = side.where("stray").select("band", "k", "rep", "class", F.lit(True).alias("left"), part("nl").alias("lb"), every("nr").alias("rb"))
    right = side.select("band", "k", "rep", "class", F.lit(False).alias("left"), part("nr").alias("rb"), every("nl").alias("lb"))
    rows = stored(left.unionByName(right), "blocks").join(reps.select("rep", "sig", "plain"), "rep")
    key = ["band", "lb", "rb"]
    most = DENSE
    found = stored(rows.select(*key, "k", "rep", "class", "left", "sig", "plain").repartition(*key).sortWithinPartitions(*key)
                   .mapInArrow(lambda b: _few(b, most), "a long, b long, band long, lb int, rb int"), "stray-pairs")
    links = linked(found.where("a is not null").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), texts)
    dense = found.where("a is null").select(*key)
    if dense.isEmpty():
        return links
    # every member of a bucket is in a pair with its leader, so ``texts`` has it
    rows = rows.join(dense, key).join(texts, "rep")
    more = (rows.select(*key, "k", "rep", "class", "left", "sig", "plain", "text").repartition(*key).sortWithinPartitions(*key)
            .mapInArrow(_dense, "a long, b long"))
    return links.unionByName(stored(more, "dense-links"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, rep (smallest doc_id of its exact copies) and class_id of every document."""
    with temporary(docs.sparkSession):
        return stored(_classes(docs), "classes", keep=True)


def _classes(docs: DataFrame) -> DataFrame:
    signs = signed(F.col("text").cast("string"))
    rows = stored(docs.where("doc_id is not null").select("doc_id", "text").withColumn("s", signs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("copy"), "text").alias("k2"),
        "s.wordy", "s.sig", "s.plain", "s.bands"), "signatures")
    # copies: a row for each task and text
    own = rows.groupBy("doc_id").agg(F.min("k1").alias("k1"))
    ids = rows.select("doc_id", "k1", "k2", "wordy").distinct().join(own, ["doc_id", "k1"])
    copies = stored(ids.where("wordy").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")), "copies")
    member = stored(ids.join(copies, ["k1", "k2"], "left").select("doc_id", F.when(F.col("wordy"), F.col("rep")).otherwise(
        F.col("doc_id")).alias("rep")).distinct(), "members")
    reps = stored(rows.where("wordy").join(copies.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2", "doc_id"])
                  .select(F.col("doc_id").alias("rep"), "sig", "plain", "bands").dropDuplicates(["rep"]), "representatives")
    # where both signatures have a band in common, its second row goes
    in_band = (reps.select("rep", F.posexplode("bands").alias("at", "band"), "bands")
               .where(f"at < {BANDS} or bands[at] <> bands[greatest(at - {BANDS}, 0)]").select("rep", F.expr(f"at % {BANDS}").alias("k"), "band"))
    # ids xor band: a bijection whose order differs from band to band, so the smallest is a leader chosen by hash
    leaders = stored(in_band.groupBy("band").agg(F.min(F.col("rep").bitwiseXOR(F.col("band"))).alias("x"), F.count("*").alias("n"))
                     .where("n > 1").select("band", F.col("x").bitwiseXOR(F.col("band")).alias("leader")), "leaders")
    both = stored(in_band.join(leaders, "band"), "buckets")
    ordered = [F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")]
    pairs = stored(both.where("rep <> leader").select(*ordered).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
                   .join(wanted.hint("merge"), "rep").groupBy("rep").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "texts")
    links = linked(pairs, texts)
    found = components(links)
    # members of a bucket that still are in several classes are compared among each other
    of = both.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "band", "k", "rep", F.coalesce("class", "rep").alias("class"))
    sizes = of.groupBy("band", "class").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band").agg(F.max(F.struct("n", "class")).alias("top"), F.count("*").alias("k")).where("k > 1")
    mixed = stored(main.select("band", F.col("top.class").alias("main")), "mixed")
    if not mixed.isEmpty():
        later = stray_links(of.join(mixed, "band"), reps, pairs, texts)
        if not later.isEmpty():
            found = components(links.unionByName(later))
    return member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", "rep", F.coalesce("class", "rep").alias("class_id"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_near_dup": (op7_near_dup, None)}
