"""WARC archives: round trip, revisits, and lookups by the two-level index."""

import hashlib

import pytest

from outagelens.llm import warc as W


@pytest.fixture(scope="module")
def pages():
    big, other = "<p>" + "é" * 600 + "</p>", "WARC/1.1\r\n\r\n" * 100
    rows = [(i, f"https://www.site{i % 7}.example.com:443/p/{i}?q={i}#top", f"<html>{i}</html>" * (i % 90)) for i in range(300)]
    rows += [(1000 + i, "http://Blog.example.org/x", big) for i in range(20)] + [(2000, "http://a.example.org", other), (1999, None, other)]
    return rows + [(3000, "not a url [", None), (3001, "http://t.example.org/a\tb\nc", ""), (None, "http://n.example.org/", "x" * 2000), (2000, "http://a.example.org", other)]


def brute(rows):
    top = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None:
            top[p] = max(i, top.get(p, i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        later = len(p) >= 1000 and p in top and i != top[p]
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if later else "response", top[p] if later else None))
    return sorted(out, key=str)


def test_round_trip_and_lookup(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_LINES", 16)
    monkeypatch.setattr(W, "FILE_RECORDS", 50)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    archives, index = str(tmp_path / "warc"), str(tmp_path / "index")
    W.write_archives(df, archives)
    W.write_index(spark, archives, index)
    assert sorted(map(tuple, W.read_captures(spark, archives, index).collect()), key=str) == brute(pages)
    found = W.CaptureIndex(spark, index)
    assert len(found.directory) >= len(pages) // 16
    lines = found.lookup("http://www.site3.example.com/p/45?q=45")
    assert len(lines) == 1 and found.read(lines[0])[1] == pages[45][2].encode()
    many = found.lookup("https://blog.example.org/x")
    kinds = [found.read(x)[0]["WARC-Type"] for x in many]
    assert len(many) == 20 and kinds.count("response") == 1
    assert found.lookup("http://nowhere.example.net/") == []


def test_keys():
    assert W.reversed_host_key("HTTP://WWW.Example.COM:80/a?b#c") == "com,example,www)/a?b"
    assert W.reversed_host_key("http://example.com:8080") == "com,example:8080)/"
    assert W.reversed_host_key(None) == ")/"


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    archives, index = str(tmp_path / "warc"), str(tmp_path / "index")
    W.write_archives(df, archives)
    W.write_index(spark, archives, index)
    assert W.read_captures(spark, archives, index).count() == 0
    assert W.CaptureIndex(spark, index).lookup("http://a.example.org") == []


def test_captures_are_looked_up_in_the_directory_and_read_by_range(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_LINES", 16)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    archives, index = str(tmp_path / "warc"), str(tmp_path / "index")
    W.write_archives(df, archives)
    W.write_index(spark, archives, index)
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(W.read_captures(spark, archives, index, df.select("url"))) == brute(pages)
    # bytes that no line lists are not read
    for file in (tmp_path / "warc").glob("part-*"):
        with file.open("ab") as f:
            f.write(b"no record\r\n\r\n")
        (tmp_path / "warc" / f".{file.name}.crc").unlink(missing_ok=True)
    some = {p[1] for p in pages[40:60]} | {"http://blog.example.org/x", "http://t.example.org/a\tb\nc", "http://nowhere.example.net/"}
    urls = spark.createDataFrame([(u,) for u in some] * 2, "url string")
    keys = {W.index_key(u) for u in some}
    assert rows(W.read_captures(spark, archives, index, urls)) == sorted((x for x, p in zip(brute_in_order(pages), pages) if W.index_key(p[1]) in keys), key=str)
    # a block that the directory doesn't list is not found
    first = W.CaptureIndex(spark, index).directory[0]
    listed = spark.read.parquet(f"{index}/directory")
    lost = str(tmp_path / "lost")
    spark.read.parquet(f"{index}/blocks").write.parquet(f"{lost}/blocks")
    listed.where((listed.part != first[2]) | (listed.block != first[3])).write.parquet(f"{lost}/directory")
    assert len(rows(W.read_captures(spark, archives, lost, df.select("url")))) == len(pages) - 16


def test_key_of_a_url_is_that_of_its_record():
    assert W.index_key("http://t.example.org/a\r\nb") == W.reversed_host_key("http://t.example.org/a  b")
    assert "\t" not in W.index_key("not a url [\t") and W.index_key(None) == ")/"


def brute_in_order(rows):
    return [brute_of(rows, r) for r in rows]


def brute_of(rows, row):
    p = (row[2] or "").encode()
    top = max((i for i, _, h in rows if i is not None and (h or "").encode() == p), default=None)
    later = len(p) >= 1000 and top is not None and row[0] != top
    return row[0], len(p), hashlib.sha1(p).hexdigest(), "revisit" if later else "response", top if later else None
