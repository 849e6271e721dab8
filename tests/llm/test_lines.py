"""Line dedup against a plain Python version, and its edge cases."""

from outagelens.llm.line_dedup import dedup_lines


def brute(rows):
    rows = {i: t for i, t in rows}  # rows that share a doc_id are one document
    first, gone = {}, {i: set() for i in rows}
    lines = {i: t.split("\n") for i, t in rows.items() if t is not None and i is not None}
    for i in sorted(lines):
        for k in range(len(lines[i]) - 2):
            win = tuple(lines[i][k:k + 3])
            if all(not x.strip(" ") for x in win):
                continue
            if win in first:
                gone[i] |= {k, k + 1, k + 2}
            else:
                first[win] = (i, k)
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows.items()}


def test_same_as_plain_python(docs, awkward):
    got = dedup_lines(docs).select("doc_id", "kept_text").collect()
    want = brute(awkward)
    assert len(got) == len(awkward)
    assert all(r["kept_text"] == want[r["doc_id"]] for r in got)
    assert sum(len(want[100 + i]) for i in range(1, 5)) < sum(len(dict(awkward)[100 + i]) for i in range(1, 5))


def test_null_ids_clashing_columns_and_no_rows(spark, none):
    rows = [(None, "a\nb\nc", 1), (None, "a\nb\nc", 2), (1, "a\nb\nc", 3), (2, "x\na\nb\nc", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_LINES int")
    got = sorted((r["doc_id"] or 0, r["kept_text"], r["n_lines"], r["n_removed"]) for r in dedup_lines(df).collect())
    assert got == [(0, "a\nb\nc", 3, 0), (0, "a\nb\nc", 3, 0), (1, "a\nb\nc", 3, 0), (2, "x", 4, 3)]
    assert dedup_lines(none).count() == 0


def test_a_window_repeated_in_one_document(spark):
    df = spark.createDataFrame([(1, "\n".join(["a", "b", "c"] * 3))], "doc_id long, text string")
    assert dedup_lines(df).first()["kept_text"] == brute([(1, "\n".join(["a", "b", "c"] * 3))])[1]
