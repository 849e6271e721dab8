"""Conversation prefix trie: padded turn-id matrices, sorted and cut shard by shard.

A conversation becomes one row: for each turn two 64-bit hashes of (role, text) and the words of its text; the texts
themselves never move. Rows are range-partitioned by their turns and their id, so a node's members follow each other, in one
shard or in several. A task numbers its turns (order of the hashes kept), lays them out as a matrix of COLUMNS turns a row,
padded with 0, and sorts it with ``lexsort``. Where a column differs from the row above, a node starts, and so it does in all
columns behind: an accumulated OR of the change masks marks the starts of every depth, and ``reduceat`` between them counts
members and finds the smallest. Rows that go on are laid out for the next columns, so padding stays under COLUMNS a row.

Only nodes on the path of a shard's first or last row can have members in other shards. A shard gives their part and what its
complete nodes hold, at most two paths of rows a shard; one pass over these, in order of the shards, with the open path on a
stack, joins the parts and adds up the subtrees. The ids that end at such a node are hashed in order from chunks of bounded size.

Edge cases: rows without conv_id take no part; a null role or text is an empty one; a null turn comes first; equal turn numbers
are ordered by the hashes, repeated rows are turns of their own; a rebuilt conversation without turns ends at the root; long
texts only add to a count; an empty table gives no rows; extra columns are ignored. One row holds a conversation's ids
(20 bytes a turn), so that is what must fit a task: some ten million turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outagelens.llm.common import stored, table, temporary

#: turns of a matrix row; turns (and conversations) of a shard; ids of a chunk
COLUMNS, SHARD_TURNS, CHUNK_IDS = 16, 200_000, 1_000
#: conversations of a family share the first turns of its first one, FEWER_THAN - 1 at most
FAMILY, FEWER_THAN = 20, 4

EMPTY = hashlib.sha256(b"").hexdigest()
SHARD = ("kind int, shard int, seq int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, t1 long, t2 long, words long, chunk long, ids binary")
NODE, PATH, ENDS = 0, 1, 2


def conversations(df: DataFrame) -> DataFrame:
    """conv_id and turns (t1, t2, words), in order, of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = df.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit("turn"), role, text).alias("t2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "t1", "t2", "words")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns")).select(
        "conv_id", F.transform("turns", lambda x: F.struct(x["t1"].alias("t1"), x["t2"].alias("t2"), x["words"].alias("words"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation with the first turns of its family's first conversation in place of its own."""
    heads = convs.where(f"conv_id % {FAMILY} = 0").select(
        F.col("conv_id").alias("first"), F.slice("turns", 1, FEWER_THAN - 1).alias("head"))
    own = convs.withColumn("first", F.expr(f"conv_id - conv_id % {FAMILY}")).withColumn(
        "h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % FEWER_THAN).cast("int"))
    return own.join(heads, "first", "left").select("conv_id", F.expr(
        "concat(if(head is null, slice(turns, 1, 0), slice(head, 1, h)), slice(turns, h + 1, size(turns)))").alias("turns"))


class Level(NamedTuple):
    """Nodes of a depth in sorted order: parent's place in the level above, smallest member, members, place of the last turn."""

    parent: np.ndarray
    low: np.ndarray
    n: np.ndarray
    turn: np.ndarray


def levels(c: np.ndarray, lens: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """The nodes of every depth, and for each row the place of the node it ends at in the level of its length."""
    off = np.cumsum(lens) - lens
    order = np.lexsort((t2, t1))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(t1[order]) != 0) | (np.diff(t2[order]) != 0)
    ids = np.zeros(len(order) + 1, dtype=np.int32)  # the last one is padding
    ids[order] = np.cumsum(new)
    out = [Level(np.array([-1]), np.array([c.min()]), np.array([len(c)]), np.array([-1]))]
    end = np.zeros(len(c), dtype=np.int64)
    rows = np.flatnonzero(lens > 0)
    group, base = np.zeros(len(rows), dtype=np.int64), 0
    while len(rows):
        left = lens[rows] - base
        cols = np.arange(min(COLUMNS, left.max()))
        m = ids[np.where(cols < left[:, None], (off[rows] + base)[:, None] + cols, -1)]
        order = np.lexsort((c[rows], *m.T[::-1], group))
        rows, group, m = rows[order], group[order], m[order]
        change = np.ones((len(rows), len(cols) + 1), dtype=bool)
        change[1:, 0] = np.diff(group) != 0
        change[1:, 1:] = m[1:] != m[:-1]
        np.logical_or.accumulate(change, axis=1, out=change)
        node, members = group, c[rows]
        for j in cols.tolist():
            starts = np.flatnonzero(change[:, j + 1])
            real = m[starts, j] > 0
            low, n = np.minimum.reduceat(members, starts), np.diff(starts, append=len(rows))
            here = np.repeat(np.where(real, np.cumsum(real) - 1, -1), n)
            first = starts[real]
            out.append(Level(node[first], low[real], n[real], off[rows[first]] + base + j))
            last = lens[rows] == base + j + 1
            end[rows[last]] = here[last]
            node = here
        on = lens[rows] > base + len(cols)
        rows, group, base = rows[on], node[on], base + len(cols)
    return out, end


def _under(values: np.ndarray, level: Level, above: int) -> np.ndarray:
    """``values`` of a level's nodes added up by parent."""
    total = np.zeros(above, dtype=np.int64)
    if len(values):
        starts = np.flatnonzero(np.diff(level.parent, prepend=-1))
        total[level.parent[starts]] = np.add.reduceat(values, starts)
    return total


def _paths(tree: list[Level], ending: dict) -> dict[tuple[int, int], int]:
    """(depth, node) -> number, of the nodes above the first and the last row: shared ones, then the first's, then the last's."""
    def walk(last: bool) -> list[tuple[int, int]]:
        path = [(0, 0)]
        while len(path) < len(tree) and (last or path[-1] not in ending):
            parents = tree[len(path)].parent
            at = int(np.searchsorted(parents, path[-1][1], "right" if last else "left")) - last
            if at < 0 or at >= len(parents) or parents[at] != path[-1][1]:
                break
            path.append((len(path), at))
        return path

    return {node: i for i, node in enumerate(dict.fromkeys(walk(False) + walk(True)))}


def _batch(**columns) -> pa.RecordBatch:
    n = len(columns["shard"])
    kinds = {"kind": pa.int32(), "shard": pa.int32(), "seq": pa.int32(), "ends_sha256": pa.string(), "ids": pa.binary()}
    names = [c.split()[0] for c in SHARD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else
                                       pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names=names)


def shard_nodes(shard: int, c: np.ndarray, lens: np.ndarray, t1: np.ndarray, t2: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Complete nodes (NODE), parts of nodes on the two outer paths (PATH) and the ids that end at those (ENDS)."""
    tree, end = levels(c, lens, t1, t2)
    order = np.lexsort((c, end, lens))
    cuts = np.flatnonzero((np.diff(lens[order]) != 0) | (np.diff(end[order]) != 0)) + 1
    ending = {(int(lens[order[lo]]), int(end[order[lo]])): c[order[lo:hi]] for lo, hi in zip((0, *cuts), (*cuts, len(order)), strict=True)}
    paths = _paths(tree, ending)
    seq = [np.full(len(t.n), -1) for t in tree]
    for (depth, at), number in paths.items():
        seq[depth][at] = number
    hashes: dict[int, tuple[list[int], list[str]]] = {}
    for (depth, at), ids in ending.items():
        if (depth, at) in paths:
            parts = [",".join(map(str, ids[i:i + CHUNK_IDS].tolist())).encode() for i in range(0, len(ids), CHUNK_IDS)]
            yield _batch(kind=[ENDS] * len(parts), shard=[shard] * len(parts), seq=[paths[depth, at]] * len(parts),
                         chunk=range(len(parts)), ids=parts)
        else:
            places, digests = hashes.setdefault(depth, ([], []))
            places.append(at)
            digests.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
    kids = leaves = saved = None
    for depth in range(len(tree) - 1, -1, -1):
        t, size = tree[depth], len(tree[depth].n)
        if depth + 1 < len(tree):
            inner, below = seq[depth + 1] < 0, tree[depth + 1]
            kids, leaves, saved = (_under(np.where(inner, v, 0), below, size) for v in (np.ones(len(inner), np.int64), leaves, saved))
        else:
            kids, leaves, saved = np.zeros((3, size), dtype=np.int64)
        own, w = seq[depth] < 0, words[t.turn] if depth else np.zeros(1, np.int64)
        leaves = np.where(own & (kids == 0), 1, leaves)
        saved = np.where(own, saved + (t.n - 1) * w, saved)
        some = np.flatnonzero(own)
        if len(some):
            digests = np.full(size, EMPTY, dtype=object)
            if depth in hashes:
                digests[hashes[depth][0]] = hashes[depth][1]
            above = t.parent[some]
            open_end = seq[depth - 1][above]
            yield _batch(kind=np.full(len(some), NODE), shard=np.full(len(some), shard),
                         seq=pa.array(open_end, pa.int32(), mask=open_end < 0),
                         conv_id=t.low[some], depth=np.full(len(some), depth),
                         parent_conv_id=pa.array(tree[depth - 1].low[above], mask=open_end >= 0),
                         n_convs=t.n[some], n_children=kids[some], n_leaves=leaves[some], saved_tokens=saved[some],
                         ends_sha256=digests[some].tolist())
        for at in np.flatnonzero(~own).tolist():
            turn = int(t.turn[at])
            yield _batch(kind=[PATH], shard=[shard], seq=[seq[depth][at]], conv_id=[t.low[at]], depth=[depth], n_convs=[t.n[at]],
                         n_children=[kids[at]], n_leaves=[leaves[at]], saved_tokens=[saved[at]], t1=[t1[turn] if depth else 0],
                         t2=[t2[turn] if depth else 0], words=[w[at] if depth else 0])


def _shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    rows = pa.Table.from_batches(got).combine_chunks()
    lists = rows.column(1).combine_chunks() if isinstance(rows.column(1), pa.ChunkedArray) else rows.column(1)
    turns = lists.flatten()
    yield from shard_nodes(TaskContext.get().partitionId(), np.asarray(rows.column(0)), np.asarray(pc.list_value_length(lists)).astype(np.int64),
                           *(np.asarray(pc.struct_field(turns, i)) for i in range(3)))


def joined_paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole nodes from the parts of all shards, in order (shard, seq), and which parts make up each (a row for each part)."""
    nodes: list[dict] = []
    parts: list[tuple[int, int, int]] = []
    path: list[int] = []

    def close(depth: int) -> None:
        while len(path) > depth:
            node = nodes[path.pop()]
            node["n_leaves"] = node["n_leaves"] if node["n_children"] else 1
            node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
            if path:
                above = nodes[path[-1]]
                above["n_children"] += 1
                above["n_leaves"] += node["n_leaves"]
                above["saved_tokens"] += node["saved_tokens"]

    for b in batches:
        for r in b.to_pylist():
            depth = r["depth"]
            if depth < len(path) and depth and (r["t1"], r["t2"]) != (nodes[path[depth]]["t1"], nodes[path[depth]]["t2"]):
                close(depth)
            if depth < len(path):
                node = nodes[path[depth]]
                node["conv_id"] = min(node["conv_id"], r["conv_id"])
                for k in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    node[k] += r[k]
            else:
                nodes.append(r | {"parent": path[-1] if path else None})
                path.append(len(nodes) - 1)
            parts.append((r["shard"], r["seq"], path[depth]))
    close(0)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "shard", "seq"]
    kinds = [pa.int64()] * 7 + [pa.int32()] * 2
    out = [(*(n[k] for k in names[:2]), None if n["parent"] is None else nodes[n["parent"]]["conv_id"], *(n[k] for k in names[3:7]), None, None)
           for n in nodes]
    out += [(nodes[at]["conv_id"], nodes[at]["depth"], *[None] * 5, shard, seq) for shard, seq, at in parts]
    for lo in range(0, len(out), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[lo:lo + 10_000], strict=True), kinds, strict=True)], names=names)


def hashed_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, depth and SHA-256 of the comma-joined ids, from chunks sorted by (conv_id, depth, shard, chunk)."""
    key, state, out = None, None, []
    for b in batches:
        for conv_id, depth, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 4)), strict=True):
            if (conv_id, depth) != key:
                out += [(*key, state.hexdigest())] if key else []
                key, state = (conv_id, depth), hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
    out += [(*key, state.hexdigest())] if key else []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["conv_id", "depth", "ends_sha256"])


def prefix_trie(convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``convs`` (conv_id, turns), each conversation once."""
    convs = stored(convs, "trie-conversations")
    size = convs.agg(F.coalesce(F.sum(F.size("turns") + 1), F.lit(0))).first()[0]
    shards = int(size) // SHARD_TURNS + 1
    found = stored(convs.repartitionByRange(shards, "turns", "conv_id").mapInArrow(_shard, SHARD), "trie-shards")
    parts = found.where(f"kind = {PATH}").select(
        "shard", "seq", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "t1", "t2", "words")
    # two paths for each shard, whatever its rows
    outer = stored(parts.repartition(1).sortWithinPartitions("shard", "seq").mapInArrow(
        joined_paths, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "shard int, seq int"), "trie-paths")
    refs = outer.where("shard is not null").select("shard", "seq", F.col("conv_id").alias("of"), F.col("depth").alias("of_depth"))
    chunks = found.where(f"kind = {ENDS}").select("shard", "seq", "chunk", "ids").join(refs, ["shard", "seq"])
    ends = (chunks.select(F.col("of").alias("conv_id"), F.col("of_depth").alias("depth"), "shard", "chunk", "ids")
            .repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "shard", "chunk")
            .mapInArrow(hashed_ends, "conv_id long, depth long, ends_sha256 string"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = outer.where("shard is null").drop("shard", "seq").join(ends, ["conv_id", "depth"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    inner = found.where(f"kind = {NODE}")
    # children of a node on a path: its id is known now (a shard has two paths, so no key is hot)
    under = inner.where("seq is not null").drop("parent_conv_id").join(
        refs.select("shard", "seq", F.col("of").alias("parent_conv_id")), ["shard", "seq"])
    return whole.select(*columns).unionByName(inner.where("seq is null").select(*columns)).unionByName(under.select(*columns))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with temporary(spark):
        # both sides of the family join read the conversations
        convs = stored(conversations(table(spark, sf_dir, "conversations")), "trie-turns")
        return stored(prefix_trie(rebuilt(convs)), "trie", keep=True)


SQL = r"""
with own as (
  select conv_id as c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, role nulls first, text nulls first) as turns
  from conversations where conv_id is not null group by conv_id),
heads as (
  select c, turns, xor(list_reduce(list_transform(range(1, length(c::varchar) + 1), lambda i: ord(substr(c::varchar, i, 1))::bigint),
      lambda crc, byte: list_reduce(range(8)::bigint[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)), 4294967295::bigint),
      4294967295) % 4 as h
  from own),
rebuilt as (
  select a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) as s
  from heads a left join own b on b.c = a.c - a.c % 20),
paths as (
  select c, d, len(s) as n, sha256(to_json(s[1:d])::varchar) as k, case when d > 0 then sha256(to_json(s[1:d - 1])::varchar) end as up,
    case when d > 0 then len(regexp_extract_all(s[d].t, '[^\x20\x09-\x0D]+')) else 0 end as words
  from (select c, s, unnest(range(0, len(s) + 1)) as d from rebuilt)),
nodes as (
  select d, k, min(up) as up, min(c) as conv_id, count(*) as n_convs, min(words) as words,
    coalesce(string_agg(c::varchar, ',' order by c) filter (where n = d), '') as ends
  from paths group by d, k),
kids as (select d - 1 as d, up as k, count(*) as n_children from nodes where d > 0 group by d, up),
full_nodes as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (d, k)),
totals as (
  select p.d, p.k, sum(case when n.n_children = 0 then 1 else 0 end) as n_leaves, sum((n.n_convs - 1) * n.words) as saved_tokens
  from full_nodes n join paths p on p.c = n.conv_id and p.d <= n.d group by p.d, p.k)
select a.conv_id, a.d::bigint as depth, b.conv_id as parent_conv_id, a.n_convs::bigint as n_convs, a.n_children::bigint as n_children,
  t.n_leaves::bigint as n_leaves, t.saved_tokens::bigint as saved_tokens, sha256(a.ends) as ends_sha256
from full_nodes a join totals t using (d, k) left join nodes b on b.d = a.d - 1 and b.k = a.up
"""

QUERIES = {"op12_prefix_trie": (op12_prefix_trie, SQL)}
