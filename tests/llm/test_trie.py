"""Conversation prefix trie against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib

import pytest

from outagelens.llm import trie as T

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuild(rows):
    """conv_id -> rebuilt turns, from (conv_id, turn, role, text) without ties."""
    own = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    head = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[:head[c]] + turns[head[c]:] for c, turns in own.items()}


def plain(convs):
    """All nodes, from a dictionary prefix -> members."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids.setdefault(p, 0)
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + ((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
            leaves[p[:-1]] = leaves.get(p[:-1], 0) + leaves[p]
            saved[p[:-1]] = saved.get(p[:-1], 0) + saved[p]
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(
        ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def rows_of(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*COLUMNS).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)


def trie(spark, rows):
    return T.prefix_trie(T.rebuilt(T.conversations(frame(spark, rows))))


def chats(seed, n, most=6, choices=3):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi there", "a\tb  c", "", None, "so it is"][:choices + 1]))
            for c in range(n) for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("shard_turns", [1, 7, 100_000])
@pytest.mark.parametrize("columns", [1, 2, 16])
def test_nodes_equal_a_dictionary(spark, monkeypatch, shard_turns, columns):
    monkeypatch.setattr(T, "SHARD_TURNS", shard_turns * 20)
    monkeypatch.setattr(T, "COLUMNS", columns)
    monkeypatch.setattr(T, "CHUNK_IDS", 3)
    rows = chats(1, 150) + [(c, t, "user", f"turn {t}") for c in range(300, 400) for t in range(5)]  # a hot conversation
    rows += [(500, None, "system", "first"), (500, 3, "user", "third"), (None, 1, "user", "lost"), (521, 0, "user", "only turn of one without base")]
    assert rows_of(trie(spark, rows)) == plain(rebuild(rows))


def test_long_conversations_and_texts(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_TURNS", 300)
    rng = random.Random(2)
    long = [rng.choice(["x", "y y"]) for _ in range(400)]
    rows = [(c, t, "user", text) for c in (40, 41, 42) for t, text in enumerate(long[:300 + c])]
    rows += [(c, 0, "user", "word " * 100_000) for c in (60, 80)]
    assert rows_of(trie(spark, rows)) == plain(rebuild(rows))


def test_copies_and_families_share_nodes(spark):
    rows = [(c, t, "user", f"{t}") for c in (0, 1, 2, 3, 20, 21) for t in range(c % 4 + 1)]
    assert rows_of(trie(spark, rows)) == plain(rebuild(rows))


def test_repeated_rows_are_turns_and_ties_are_stable(spark):
    rows = [(20, 1, "user", "same")] * 3 + [(40, 1, "user", "a"), (40, 1, "user", "b")]
    got = rows_of(trie(spark, rows))
    assert got == rows_of(trie(spark, rows[::-1]))
    assert max(r[1] for r in got if r[0] == 20) == 3


def test_edges(spark):
    assert rows_of(trie(spark, [])) == [] and rows_of(trie(spark, [(None, 1, "user", "x")])) == []
    # no base, and all own turns replaced: the conversation ends at the root
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert rows_of(trie(spark, [(c, 0, "user", "x")])) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_extra_columns_with_clashing_names(spark):
    rows = chats(3, 30)
    df = frame(spark, rows).selectExpr("*", "1 as shard", "'x' as turns", "2 as words", "3 as depth")
    assert rows_of(T.prefix_trie(T.rebuilt(T.conversations(df)))) == plain(rebuild(rows))


def test_query_over_the_whole_table(spark):
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.001"
    t = pq.read_table(f"{d}/conversations.parquet").to_pylist()
    assert rows_of(T.op12_prefix_trie(spark, d)) == plain(rebuild([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in t]))
