import pytest

import corpus_pipeline
from quern.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_binary_top_k": {"query_id", "neighbor_id", "distance", "rank"},
    "op2_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op3_near_duplicates": {"doc_id", "n_shingles", "component_id", "kept"},
    "op4_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op5_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op6_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op7_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op8_language_model": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op9_token_ids": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op10_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op11_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op12_periodic_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op13_vector_codes": {"vec_id", "code", "error", "label_error", "codebooks_sha256"},
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    ours, theirs = compare(spark, QUERIES[name], ORACLES[name], FOLDER)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_has_its_columns(spark, name):
    got = QUERIES[name](spark, FOLDER)
    assert COLUMNS[name] <= set(got.columns)
    if name not in ("op1_binary_top_k", "op4_chat_format", "op5_packing", "op6_html_extraction", "op13_vector_codes"):
        assert got.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
        if name == "near-duplicates":
            assert docs.count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).select("doc_id").distinct().count() == n
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_one_of_each_with_repeated_and_nameless_rows(spark):
    text = "one two three four five six seven"
    rows = [(2, text, "en", "s", 1), (2, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text, "en", "s", 1), (None, "something else altogether is here", "en", "s", 1), (3, None, "en", "s", 1), (4, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_one_of_each(spark, docs, FOLDER).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, "something else altogether is here"), (1, text), (3, ""), (4, "")]
