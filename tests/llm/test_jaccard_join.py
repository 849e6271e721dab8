"""Parity-sketch join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from outagelens.llm import jaccard_join as J
from tests.llm.conftest import WORDS, prose

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain(rows):
    """(doc_id, n_shingles, component_id), by all pairs."""
    sets = [shingles_of(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and (
                    rows[i][0] == rows[j][0] or both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((-1 if d is None else d, len(sets[i]), -1 if d is None else least[find(i)]) for i, (d, _) in enumerate(rows))


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted(tuple(-1 if v is None else v for v in r) for r in J.linked_components(df).collect())


def variants(rng, size, count, rate):
    """Copies of a text of invented words, each with some of its words replaced."""
    base = [f"{rng.choice(WORDS)}{rng.randrange(1000)}" for _ in range(size)]
    return [" ".join(f"new{rng.randrange(10 ** 9)}" if rng.random() < rate else w for w in base) for _ in range(count)]


def test_components_equal_all_pairs(spark, awkward):
    rng = random.Random(1)
    texts = [t for size in (3, 5, 6, 9, 20, 33, 64, 70, 127, 131, 260, 700) for rate in (0.005, 0.02, 0.04) for t in variants(rng, size, 5, rate)]
    rows = awkward + [(1000 + i, t) for i, t in enumerate(texts)]
    rows += [(3000, "One two THREE four five six"), (3001, "one two three four FIVE six"), (3002, "ÉTÉ one two three four"),
             (3003, "été one two three four"), (None, "one two three four five six"), (None, None)]
    # rows that share an id link what their texts link
    rows += [(3004, texts[0]), (3004, texts[60]), (3004, texts[100])]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("block", [7, 2048])
def test_a_large_group_of_near_copies(spark, monkeypatch, block):
    """Neighbours at many distances: components are chains, most pairs are just under the threshold."""
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "BUFFER", 50)
    rng = random.Random(block)
    rows = [(i, t) for i, t in enumerate(variants(rng, 110, 150, 0.03))]
    now = rows[0][1].split()
    for i in range(40):  # a chain: each differs from the one before by a few words
        for _ in range(2):
            now[rng.randrange(len(now))] = f"w{rng.randrange(10 ** 9)}"
        rows.append((500 + i, " ".join(now)))
    assert got(spark, rows) == plain(rows)


def test_common_lines_do_not_link(spark):
    rng = random.Random(3)
    line = prose(rng, 40)
    rows = [(i, line + " " + " ".join(f"x{rng.randrange(10 ** 9)}" for _ in range(rng.randrange(5, 60)))) for i in range(200)]
    assert got(spark, rows) == plain(rows)


def test_similar_sets_list_a_common_block():
    """Any two sets of Jaccard similarity 0.8 or more, of all sizes and in all orders of rarity, have a listed block in common."""
    rng = np.random.default_rng(5)
    for _ in range(1500):
        both = int(2 ** rng.uniform(0, 10))
        extra = both // 4
        a, b = (int(rng.integers(0, extra + 1)) for _ in range(2))
        if rng.random() < 0.5:
            a, b = (extra, 0) if rng.random() < 0.5 else (a, extra - a if extra >= a else 0)
        if 100 * both < 80 * (both + a + b):
            continue
        e = rng.integers(0, 2 ** 64, both + a + b, dtype=np.uint64)
        rare = rng.integers(0, 4, len(e)).astype(np.uint8)  # many ties
        x, y = np.r_[:both + a], np.r_[:both, both + a:both + a + b]
        owner = np.repeat([0, 1], [len(x), len(y)])
        who, keys = J.listed_blocks(owner, np.concatenate((e[x], e[y])), np.concatenate((rare[x], rare[y])), np.array([len(x), len(y)]))
        assert set(keys[who == 0].tolist()) & set(keys[who == 1].tolist()), (both, a, b)
        s, t = J.parity_bits(owner, np.concatenate((e[x], e[y])), np.array([len(x), len(y)]))
        size = min(len(s), len(t)) * 8
        s, t = (J._folded([v], size)[0] for v in (s, t))
        assert int(np.bitwise_count(s ^ t).sum()) <= a + b


def test_pairs_kept_back_at_first_are_still_found(spark, monkeypatch):
    # sketches that tell nothing: every pair of a bucket is a candidate
    monkeypatch.setattr(J, "parity_bits", lambda owner, elements, n: [bytes(int(x) // 8) for x in J._bits(n)])
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(variants(rng, 60, 40, 0.04))]
    assert got(spark, rows) == plain(rows)


def test_edges(spark, none):
    assert J.linked_components(none).collect() == []
    assert got(spark, [(1, None), (2, ""), (3, " \t\n")]) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    df = spark.createDataFrame([(1, "a b c", 5, "x"), (2, "A B C", 6, "y")], "doc_id long, text string, rep long, keys string")
    assert {tuple(r) for r in J.linked_components(df).collect()} == {(1, 1, 1), (2, 1, 1)}
    assert J.similar.func(pa.array(["a b", None]), pa.array(["A  b", None])).to_pylist() == [True, False]


def test_only_texts_of_candidate_pairs_are_written(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, prose(rng, 30)) for i in range(50)] + [(7, "one more text of row seven"), (None, "no id")], "doc_id long, text string")
    pairs = spark.createDataFrame([(3, 7), (3, 20)], "a long, b long")
    found = J.texts_of(pairs, docs).collect()
    assert sorted(r["rep"] for r in found) == [3, 7, 7, 20]
    want = {(r["doc_id"], r["text"]) for r in docs.where("doc_id in (3, 7, 20)").collect()}
    assert {(r["rep"], r["text"]) for r in found} == want
