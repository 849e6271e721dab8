"""The pipeline over awkward tables, and the registered queries' columns over the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from outagelens.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    extra = docs.selectExpr("doc_id", "text", "'en' as lang", "cast(null as string) as source", "cast(length(text) as long) as n_chars",
                            "1 as n_words", "'x' as kept", "array(1) as hits", "2 as `odd.name`")
    no_id = extra.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit("no id at all")})
    extra.union(no_id).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    body = [r["text"] for r in docs.where("doc_id = 10").collect()]
    spark.createDataFrame([(1, body[0])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_keep_columns_and_rows_go(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        after = C.stored(stage(spark, docs, tables), name)
        assert after.columns == columns
        assert after.count() <= docs.count()
        docs = after
    packed = C.STAGES[-1][1](spark, docs, tables).collect()
    assert len({r["doc_id"] for r in packed}) == docs.select("doc_id").distinct().count() > 0


def test_empty_documents(spark, tables, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


COLUMNS = {
    "op2": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op3": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op4": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op5": ["doc_id", "held_out", "lang_pred", "score"],
    "op6": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op8": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op11": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op12": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13": ["doc_id", "n_shingles", "component_id"],
}
#: the table whose ids a query returns, each at least once; a conversation equal to a smaller one has no node of its own
TABLES = {"op10": ("pages", "page_id"), "op11": ("embeddings", "vec_id"), "op12": (None, None)}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_has_its_columns_and_all_rows(spark, name):
    op = name.split("_")[0]
    rows = registry.queries()[name](spark, SF)
    assert rows.columns[:len(COLUMNS.get(op, []))] == COLUMNS.get(op, [])
    table, key = TABLES.get(op, ("documents", "doc_id"))
    if table:
        assert rows.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().count()
    else:
        assert rows.where("depth = 0").count() == 1
