"""Near duplicates against all pairs; signatures and similarities against their definitions."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from outagelens.llm import near_dup as N

from .conftest import prose


def shingles(text):
    w = (text or "").encode().split()
    out = {}
    for k in range(max(1, len(w) - 4) if w else 0):
        s = tuple(w[k:k + 5])
        out[s] = out.get(s, 0) + 1
    return out


def probability_jaccard(a, b):
    ratio = lambda d: sum(max(a.get(i, 0) / a[d], b.get(i, 0) / b[d]) for i in a.keys() | b.keys())
    return sum(1 / ratio(d) for d in a.keys() & b.keys())


def similar(a, b):
    if not a or not b:
        return 0.0
    return max(probability_jaccard(a, b), len(a.keys() & b.keys()) / len(a.keys() | b.keys()))


def brute(rows):
    texts = {}
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        texts.setdefault(i, shingles(t))
    of = {i: i for i in texts}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        if texts[a].keys() & texts[b].keys() and similar(texts[a], texts[b]) >= 0.8:
            x, y = sorted((top(a), top(b)))
            of[y] = x
    return {i: top(i) for i in texts}


@pytest.fixture(scope="module")
def copies():
    """Groups of copies with few words changed, and chains in which only neighbours are similar."""
    rng = random.Random(9)
    rows, i = [], 0
    for size in (2, 3, 40):
        words = prose(rng, 150).split()
        for _ in range(size):
            own = list(words)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            rows.append((i, " ".join(own)))
            i += 1
    words = prose(rng, 200).split()
    for step in range(8):
        rows.append((i, " ".join(words[step * 8:step * 8 + 120])))
        i += 1
    return rows


@pytest.mark.parametrize("block, dense", [(2048, 4), (7, 0), (2048, 0)])
def test_classes_are_those_of_all_pairs(spark, docs, awkward, copies, monkeypatch, block, dense):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "DENSE", dense)
    moved = [(i + 10_000, t) for i, t in copies]
    df = docs.union(spark.createDataFrame(moved, "doc_id long, text string"))
    got = {r["doc_id"]: r["class_id"] for r in N.classes(df).collect()}
    assert got == brute(awkward + moved)


def test_no_rows_null_ids_and_unlike_texts(spark, none):
    assert N.classes(none).count() == 0
    df = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (3, None), (4, "a b"), (5, "a b c"), (6, "a b")], "doc_id long, text string")
    rows = N.classes(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 4}


def test_registers_agree_as_often_as_the_weights_say():
    rng = random.Random(11)
    base = prose(rng, 400).split()
    other = base[:300] + prose(rng, 60).split() + base[250:300]
    a, b = " ".join(base), " ".join(other)
    owner, runs, weight = N.shingles(pa.array([a, b]))
    sig = N.signatures(owner, runs, weight, 2)
    want = probability_jaccard(shingles(a), shingles(b))
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / N.REGISTERS) ** 0.5
    again = N.signatures(*(x[owner == 1] - (1 if k == 0 else 0) for k, x in enumerate((owner, runs, weight))), 1)
    assert np.array_equal(again[0], sig[1])  # a signature doesn't depend on the texts beside it


def test_similarity_is_the_larger_of_both_measures():
    rng = random.Random(12)
    rows = [(" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))), " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))))
            for _ in range(200)]
    got = N.similarity.func(pa.array([a for a, _ in rows]), pa.array([b for _, b in rows])).to_pylist()
    for (a, b), s in zip(rows, got):
        want = similar(shingles(a), shingles(b))
        assert s == pytest.approx(want) or (s >= 0.8) == (want >= 0.8)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(50, 60)]
    found = dict(map(tuple, N.components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {60: 50}
    assert {k: v for k, v in found.items() if k != v} == want


@pytest.fixture(scope="module")
def repeating():
    """Pairs of plain Jaccard 0.86 and probability Jaccard below 0.5: the second text ends in a line ten times."""
    out = []
    for p in range(12):
        words = " ".join(f"w{p}x{i}" for i in range(104))
        out.append((words, words + f"\n{' '.join(f'l{p}x{i}' for i in range(12))}" * 10))
    return out


def test_pairs_of_which_one_repeats_a_line_are_found(spark, repeating):
    rows = [(2 * p + s, t) for p, pair in enumerate(repeating) for s, t in enumerate(pair)]
    assert all(probability_jaccard(shingles(a), shingles(b)) < 0.5 <= 0.8 < similar(shingles(a), shingles(b)) for a, b in repeating)
    got = {r["doc_id"]: r["class_id"] for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) == {i: i - i % 2 for i, _ in rows}


def test_signatures_agree_by_either_measure(repeating):
    for pair in repeating:
        for a, b in (pair, pair[::-1]):
            signs = N.both_signatures(*N.shingles(pa.array([a, b])), 2)
            assert sorted(signs[2].tolist()) == [False, True]
            met = [k for k in range(N.BANDS) if len(N.agreeing(tuple(x[:1] for x in signs), tuple(x[1:] for x in signs), k)[0])]
            assert len(met) == 1  # in one band's block only
