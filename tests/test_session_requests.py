import json

import pytest

from textloom import session
from textloom.operators import search, tokens

DOCS = [(1, "The cat sat here. A red dog ran."), (2, "The dog sat. The Cat sat here."), (3, "Nothing to see."), (4, "A tabby sat here."), (5, "A tabby sat here.")]


@pytest.fixture(scope="module")
def parts(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    sents = tokens.sentence_table(docs)
    imp = spark.createDataFrame([("cat", 0.8), ("sat", 0.7), ("dog", 0.9), ("tabby", 0.75)], "word string, score double")
    origins = sents.selectExpr("sent_uid", "if(chunk_idx = 4, 'other', 'main') as table_name", "'text' as column_name", "'doc_id' as index_col", "7L as column_uid", "chunk_idx as row_uid", "chunk_idx as row_idx", "'China' as country", "0 as offset_beg", "length(sentence) as offset_end")
    return sents, imp, origins


def test_answers_have_all_arrays_and_the_query(spark, parts):
    sents, imp, origins = parts
    s = session.Session(spark, tokens.token_table(sents), sents, imp, origins, countries=["China", "France"])
    text = "In China the cat sat here. So did a dog."
    doc, second = json.loads(s.handle(json.dumps({"ask": text, "max_clip_len": 8})))["results"]
    assert doc["words"] == ["In", "China", "the", "cat", "sat", "here."] and doc["cutoffs"] == [0, 0, 0, 0.8, 0.7, 0]
    assert doc["countries"] == ["China"] and doc["input_offset"] == [0, 26] and second["input_offset"] == [27, 40]
    n = doc["n_relevant_matches"]
    assert n > 0 and all(len(doc[a]) == n for a in session._ARRAYS)
    best = doc["sentence"][0]
    assert best == "The cat sat here."
    span = [x for x in doc["score_with_offset"][0] if x[1:3] == [13, 16]][0]
    assert best[span[3] : span[4]] == "cat" and text[span[1] : span[2]] == "cat"
    b, e = doc["clip_offset"][0]
    assert best[b:e] == "cat sat"
    assert doc["result_table_name"][0] == "main" and doc["result_row_uid"][0] == 1 and doc["is_highly_meet"][0] == (doc["score"][0] > 1.5)
    only = json.loads(s.handle(json.dumps({"chain_query": text, "tables": ["other"]})))["results"][0]
    assert set(only["sentence"]) == {"A tabby sat here."}


def test_other_requests(spark, parts):
    sents, imp, _ = parts
    s = session.Session(spark, tokens.token_table(sents), sents, imp)
    a, b = (json.loads(s.handle(json.dumps({"raw_text": t})))["sent_uids"][0] for t in ("The cat sat", "A cat"))
    assert (a, b) == (session.FIRST_QUERY, session.FIRST_QUERY + 1)
    assert json.loads(s.handle(json.dumps({"sent_compare": [a, b]})))["score"] == pytest.approx(0.8)
    assert s.handle(json.dumps({"sent_compare": [a, 5]})) == "null"
    known = json.loads(s.handle(json.dumps({"sents": [a, 1 * tokens.SENTENCES_PER_CHUNK, 12345]})))["sents"]
    assert [x["sentence"] for x in known] == ["The cat sat", "The cat sat here."]
    stats = json.loads(s.handle(json.dumps({"stats_query": [a], "phrase_cutoff": 0.1})))
    assert stats["results"][0]["input_uid"] == a and stats["query_suggestions_per_sent"][0]["sent_uid"] == a
    assert json.loads(s.handle(json.dumps({"suggest": ["sat"], "phrase_cutoff": 1e9})))["query_suggestions"]
    assert s.handle(json.dumps({"suggest": []})) == "null" == s.handle(json.dumps({"ask_sents": [1, 2]}))


def test_words_similar_by_vectors(spark, parts):
    sents, imp, _ = parts
    vectors = spark.createDataFrame([("cat", [1.0, 0.1]), ("tabby", [1.0, 0.2]), ("dog", [0.0, 1.0]), ("cat", [1.0, 0.1]), ("none", None), (None, [1.0, 1.0])], "word string, vec array<double>")
    stated = spark.createDataFrame([("cat", 0.8), ("dog", 0.5), ("gone", 0.9)], "word string, score double")
    got = {(r.word, r.sim_word) for r in search.vector_similar(stated, vectors).collect()}
    assert got == {("cat", "cat"), ("cat", "tabby")}  # dog is noisy, gone has no vector
    s = session.Session(spark, tokens.token_table(sents), sents, imp, vectors=vectors)
    doc = json.loads(s.handle(json.dumps({"ask": "the cat"})))["results"][0]
    assert "A tabby sat here." in doc["sentence"]
