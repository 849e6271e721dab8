"""Benchmark decontamination and quality statistics against plain Python, and their edge cases."""

import hashlib
import random
import re

import pytest

from outagelens.llm import decontaminate as D
from outagelens.llm import quality as Q

from .conftest import prose

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return ITEM_WORD.findall(lower)


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(item))
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), ids, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def judged(docs, items):
    from pyspark.sql import functions as F
    rows = D.with_verdict(docs, items).select("doc_id", "n_words", "n_hit", "n_items",
                                              F.sha2(F.array_join("items", ","), 256), "contaminated").collect()
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def items(awkward):
    rng = random.Random(3)
    body = dict(awkward)[300].split()
    return [(1, " ".join(body[50:90]).upper()), (2, " ".join(body[70:75])), (10, prose(rng, 40)), (11, None), (12, ""),
            (13, "--- !"), (14, "é" * 200), (2, " ".join(body[70:75])), (15, dict(awkward)[3])]


def test_contamination_is_that_of_plain_python(spark, docs, awkward, items):
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert judged(docs, frame) == brute(awkward, items)


def test_items_in_several_blocks(spark, docs, awkward, items, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 300)
    frame = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    assert judged(docs, frame) == brute(awkward, items)


def test_empty_tables_and_clashing_columns(spark, docs, none, items):
    no_items = spark.createDataFrame([], "item_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert not any(r[-1] for r in judged(docs, no_items))
    assert judged(none, frame) == []
    odd = spark.createDataFrame([(1, "a b", "x", 1)], "doc_id long, text string, hits string, n_hit int")
    assert D.with_verdict(odd, frame).first().asDict() == {
        "doc_id": 1, "text": "a b", "hits": "x", "n_words": 2, "n_hit": 0, "n_items": 0, "items": [], "contaminated": False}


def stats(text):
    text = text or ""
    w = WORD.findall(text)
    runs = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    twice = {r for r in runs if runs.count(r) > 1} if len(runs) < 3000 else {r for r, n in __import__("collections").Counter(runs).items() if n > 1}
    covered = {k + j for k, r in enumerate(runs) if r in twice for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_statistics(spark, docs, awkward):
    extra = [(900, "same line\n\n\nsame line\n #*$%&|<> x\nsame line"), (901, "a b c a b c d\x0b\x0ce f a b")]
    frame = docs.union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = Q.with_quality(frame, labels_of(spark, [])).collect()
    got = sorted((r["doc_id"], *(r[c] for c in Q.STATS[:5]), r["base_failed"]) for r in rows)
    want = sorted((i, *(s := stats(t)), s[0] < 50 or 100 * s[4] > 50 * s[0]) for i, t in [*awkward, *extra])
    assert got == want
    assert all(r["kept"] != r["base_failed"] for r in rows)  # no labels: the base rules alone


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(5)
    good = [(i, prose(rng, 80), 1) for i in range(200)]
    bad = [(1000 + i, " ".join("buy now $$$ click win cheap".split()[rng.randrange(6)] for _ in range(80)), 0) for i in range(100)]
    df = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = labels_of(spark, [(i, q, 0) for i, _, q in good + bad if i % 3])
    rows = {r["doc_id"]: r for r in Q.with_quality(df, labels).collect()}
    assert sum(rows[i]["kept"] for i, _, _ in good) >= 195
    assert not any(rows[i]["kept"] for i, _, _ in bad)
    again = {r["doc_id"]: r["score"] for r in Q.with_quality(df.repartition(3), labels).collect()}
    assert again == {i: r["score"] for i, r in rows.items()}  # scores don't depend on the partitions


def test_quality_without_rows_and_with_null_labels(spark, none):
    assert Q.with_quality(none, labels_of(spark, [(1, None, None), (None, 1, 0)])).count() == 0


def test_toxic_rows_of_good_quality_are_not_protected(spark):
    rng = random.Random(6)
    good = [(i, prose(rng, 80), 1, 0) for i in range(300)]
    toxic = [(1000 + i, " ".join(rng.choice("vile scum filth hate rot".split()) + str(rng.randrange(40)) for _ in range(80)), 1, 1) for i in range(40)]
    bad = [(2000 + i, " ".join(rng.choice("buy now win cheap".split()) + str(rng.randrange(40)) for _ in range(80)), 0, 0) for i in range(60)]
    df = spark.createDataFrame([r[:2] for r in good + toxic + bad], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in Q.with_quality(df, labels_of(spark, [(i, q, x) for i, _, q, x in good + toxic + bad])).collect()}
    assert not any(r["base_failed"] for r in rows.values())
    assert not any(rows[i]["kept"] for i, *_ in toxic + bad)
    assert sum(rows[i]["kept"] for i, *_ in good) >= 295


def test_every_labelled_row_is_used(spark):
    labels = spark.range(20_050).selectExpr("id as doc_id", "int(id % 2) as quality", "0 as toxic")
    assert Q.labelled(labels).count() == 20_050


def test_threshold_is_that_of_sorted_scores(spark, monkeypatch):
    import numpy as np

    rng = random.Random(9)
    ratio = np.array([rng.randrange(-40_000, 40_000) for _ in range(Q.BUCKETS)])
    rows = [(i, prose(rng, 60 + i % 7), i % 3 != 0) for i in range(300)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    sample = spark.createDataFrame([(i, int(t), False) for i, _, t in rows], "doc_id long, trusted int, fit boolean")
    score = {r["doc_id"]: (r["score"], r["base_failed"]) for r in Q.scored(df, ratio).collect()}
    good = sorted(score[i][0] for i, _, t in rows if t and not score[i][1])
    bad = sorted(score[i][0] for i, _, t in rows if not t and not score[i][1])
    cuts = np.unique(good + bad)
    for most in (0.005, 0.3):
        monkeypatch.setattr(Q, "MAX_LOST", most)
        lost, caught = np.searchsorted(good, cuts) / len(good), np.searchsorted(bad, cuts) / len(bad)
        best = int(np.where(lost <= most, caught - lost, -1).argmax())
        wanted = (cuts[best - 1] + cuts[best] + 1) // 2 if best else cuts[0]
        for width in (8192, 64):
            monkeypatch.setattr(Q, "SCORE_RANGE", width)
            assert Q.threshold(df, sample, ratio) == wanted


def test_only_texts_that_may_be_labelled_are_shuffled(spark):
    df = spark.range(2000).selectExpr("if(id = 1999, null, id) as doc_id", "concat('word ', id) as text")
    ids = spark.range(0, 2000, 100).selectExpr("int(id) as doc_id")
    found = [r["doc_id"] for r in Q.maybe_labelled(df, ids).collect()]
    assert set(range(0, 2000, 100)) <= set(found) and len(found) < 30
    assert Q.maybe_labelled(df, ids).columns == ["doc_id", "text"]


def test_more_labels_than_bits_lose_no_row(spark, monkeypatch):
    df = spark.range(500).selectExpr("id as doc_id", "'a b' as text")
    monkeypatch.setattr(Q, "LABEL_BITS", 64)
    assert Q.maybe_labelled(df, spark.range(300).selectExpr("id as doc_id")).where("doc_id < 300").count() == 300
