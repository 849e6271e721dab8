"""Token ids against the tokenizers library; token files and packing."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from outagelens.llm import packing as P
from outagelens.llm import token_files as TF
from outagelens.llm.tokens import default_path, encoded, tokenizer

pytest.importorskip("public_tokenizers")

ODD = ["", " ", "Hello, World!! it's 42 o'clock", "ﬁ İSTANBUL Straße ΣΊΣΥΦΟΣ", "é é 가", "<|endoftext|> a<|startoftext|>b",
       "a b c\x1cd\x85e", "!!! *** a*** b.. ...", "日本語 テキスト", "x" * 5000, "tab\tnew\nline\x0bvt", "ÀÉÎ ß ÿ×÷", None]


def expected(text):
    return [*tokenizer(default_path()).tok.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_those_of_the_library(awkward):
    texts = ODD + [t for _, t in awkward]
    got = []
    for _, _, ids, starts in encoded(pa.array(texts, pa.string()), default_path()):
        got += [ids[s:e].tolist() for s, e in zip(starts[:-1], starts[1:])]
    assert got == [expected(t) for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, docs, awkward, tmp_path, none):
    path = str(tmp_path / "tokens")
    TF.write_token_files(docs, path, default_path())
    rows = sorted(map(tuple, TF.read_places(spark, path).collect()), key=lambda r: r[1])
    want, at = [], 0
    for i, t in sorted(awkward, key=lambda r: r[0]):
        ids = expected(t)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert rows == want
    one = TF.read_token_files(spark, path, [300]).collect()
    assert [r["ids"] for r in one] == [expected(dict(awkward)[300])]
    TF.write_token_files(none, str(tmp_path / "no"), default_path())
    assert TF.read_places(spark, str(tmp_path / "no")).count() == 0


def test_bloom_filter_and_rows_in_order(spark, docs, tmp_path):
    from pyarrow import orc
    path = str(tmp_path / "tokens")
    TF.write_token_files(docs.coalesce(1), path, default_path())
    for f in (tmp_path / "tokens").glob("part-*.orc"):
        ids = orc.ORCFile(str(f)).read(["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids)


def check(rows, most):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= most
    return len(by)


def test_packed_pieces_make_up_the_documents(spark, docs, awkward):
    rows = P.pack_documents(docs, default_path()).collect()
    texts = dict(awkward)
    used = check(rows, 4096)
    total = sum(len(expected(t)) for _, t in awkward)
    assert sum(r["length"] for r in rows) == total and used == -(-total // 4096)
    pieces = sorted(((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 300))
    ids = expected(texts[300])
    assert pieces == [(k, k * 4096, len(ids[k * 4096:(k + 1) * 4096]), crc(ids[k * 4096:(k + 1) * 4096])) for k in range(-(-len(ids) // 4096))]


@pytest.mark.parametrize("sweep_rows", [100, 100_000])
def test_packing_is_tight_over_many_partitions(spark, monkeypatch, sweep_rows):
    monkeypatch.setattr(P, "SWEEP_ROWS", sweep_rows)
    rng = np.random.default_rng(4)
    size = np.minimum(1 + rng.lognormal(5.5, 1.2, 1500).astype(int), 4096)
    items = spark.createDataFrame([(int(i), int(s)) for i, s in enumerate(size)], "uid long, length int")
    rows = P.pack(items).join(items, "uid").collect()
    assert len(rows) == len(size) == len({r["uid"] for r in rows})
    assert check(rows, 4096) <= -(-size.sum() // 4096) * 1.03 + 1


def test_equal_sizes_and_nothing(spark, none):
    items = spark.createDataFrame([(i, 1000) for i in range(41)], "uid long, length int")
    assert check(P.pack(items).join(items, "uid").collect(), 4096) == 11
    assert P.pack_documents(none, default_path()).count() == 0
