from textloom.operators import tokens
from textloom.queries import QUERIES

DOCS = "doc_id long, text string, source string"


def run(spark, name, d, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{d}/{t}.parquet")
    return QUERIES[name](spark, str(d)).collect()


def test_every_sentence_of_an_asked_text_is_a_query(spark, tmp_path):
    cat, dog = "red cat runs. ", "blue dog sleeps. "
    docs = [(i, cat + dog + cat + dog if i % 2 else dog + cat + dog + cat, "news") for i in range(101, 115)]
    docs += [(i, f"word{i} here. other{i} there.", "news") for i in range(20, 60)]
    docs += [(9, "red cat runs. blue dog sleeps.", "query.log")]
    got = run(spark, "similar_sentences", tmp_path, documents=(docs, DOCS))
    assert {r.q for r in got} == {9 * tokens.SENTENCES_PER_CHUNK, 9 * tokens.SENTENCES_PER_CHUNK + 1}


def test_documents_of_all_sources_are_asked(spark, tmp_path):
    docs = [(i, f"shared{i % 3} text{i % 2} other{i}", "wiki.intro" if i % 7 == 0 else "news") for i in range(1, 61)]
    got = run(spark, "similar_documents", tmp_path, documents=(docs, DOCS))
    assert {r["query"] for r in got} == {20, 40, 60}
    assert all(r.doc_id != r["query"] and r["rank"] <= 5 for r in got)


def test_long_sentences_have_phrases(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(150))
    got = run(spark, "phrases", tmp_path, documents=([(1, text, "news"), (2, "short text. next one.", "news")], DOCS))
    words = [w for r in got if r.sent_uid == tokens.SENTENCES_PER_CHUNK for w in r.phrase.split()]
    assert sorted(words) == sorted(text.split())


def test_every_ranked_word_with_a_vector_is_known(spark, tmp_path):
    cells = [(i, f"w{i} w{i + 1}") for i in range(0, 1200, 2)]
    vectors = [(i, [1.0, float(i % 5)]) for i in range(1200)]
    got = run(spark, "context_scores", tmp_path, ygp_rows=(cells, "row_uid long, row_str string"), embeddings=(vectors, "vec_id long, embedding array<float>"))
    assert len(got) == 600 and {r.n for r in got} == {2}


def test_rare_contexts_are_counted(spark, tmp_path):
    got = run(spark, "context_counts", tmp_path, documents=([(1, "red cat", "news")], DOCS))
    assert {tuple(r) for r in got} == {("red", "cat", 1), ("cat", "red", 1)}


def test_all_valid_matches_are_joined(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    scores = [(1, 0.5), (2, 3.5), (3, 0.0), (4, -1.0), (5, nan), (6, inf), (7, None)]
    got = run(
        spark, "results_with_rows", tmp_path,
        ask_results=([(1, i, 9, s, None) for i, s in scores], "input_uid long, result_sent_uid long, result_row_uid long, score double, result_sent_country string"),
        ygp_rows=([(9, 3, "abc")], "row_uid long, col_uid long, row_str string"),
        column_catalog=([(3, "t")], "col_uid long, table_name string"),
    )
    assert {r.result_sent_uid for r in got} == {1, 2}
