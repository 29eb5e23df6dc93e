import duckdb
from pyspark.sql import functions as F

from textloom import workspace
from textloom.ml import weighting
from textloom.operators import entities, search, tokens
from textloom.queries import QUERIES, SQL

DOCS = "doc_id long, text string, source string"

CAT, DOG = "red Cat runs. ", "blue dog sleeps. "
ODD = [(i, CAT + DOG + CAT + DOG if i % 2 else DOG + CAT + "runs red cat red cat. " + DOG + CAT, "news") for i in range(101, 115)]
ODD += [(i, f"word{i} here. other{i} there. runs. sleeps. cat.", "news") for i in range(20, 60)]
ODD += [(9, "red cat runs. blue dog sleeps. RED runs.", "query.log"), (10, "Runs sleeps.", "query.log"), (11, None, "query.log"), (12, "", "news")]


def written(spark, d, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{d}/{t}.parquet")
    return str(d)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_entity_search_hands_on_no_hits(spark, tmp_path):
    rows = [(i, f"see{i} North Lake here. the Lake of Bel{i % 3} is North Lake.", "news") for i in range(1, 30)] + [(77, "North Lake here.", "query.log")]
    items = [(i, f"Q{i}", label) for i, label in enumerate(["North Lake", "South Lake", "Bel1 of Bel2", "Bel1", "Lake"], 1)]
    d = written(spark, tmp_path, documents=(rows, DOCS), wikidata_items=(items, "rec_id long, item_id string, item_label string"))
    df = QUERIES["sentences_with_entities"](spark, d)
    assert "MapInArrow" in plan(df) and "Join" not in plan(df)
    got = {(r.q, r["rank"]): (r.sent_uid, round(r.score, 2)) for r in df.collect()}
    one = 77 * tokens.SENTENCES_PER_CHUNK
    # "North Lake" shares its entity with its last word too
    assert [got[one, k] for k in range(1, 6)] == [(i * tokens.SENTENCES_PER_CHUNK + j, 1.0) for i, j in ((1, 0), (1, 1), (2, 0), (2, 1), (3, 0))]


def test_both_searches_agree(spark):
    sim = spark.createDataFrame([("cat", "cat", 1.0), ("cat", "Cat", 0.9), ("sat", "sat", 1.0)], "word string, sim_word string, similarity double")
    q = spark.createDataFrame([(7, 0, "cat", 0.8, "sat", 0.5), (7, 1, "sat", 0.7, None, None), (7, 2, "the", 0.1, "cat", 0.8), (8, 0, "cat", 0.9, None, 0.0)], "q long, q_pos int, word string, score double, head_word string, head_score double")
    sents = [(i, [["cat", "sat"], ["Cat", "lay"], ["sat", "Cat", "cat", "x"], [], ["the"]][i % 5]) for i in range(40)]
    s = spark.createDataFrame(sents, "sent_uid long, ws array<string>")
    posts = s.select("sent_uid", "ws", F.posexplode("ws").alias("pos", "word")).select("sent_uid", "word", F.get("ws", F.col("pos") + 1).alias("head_word"))
    want = sorted(map(tuple, search.find_similar_sentences(q, sim, posts).select("q", "sent_uid", "score", "rank").collect()))
    for rows in (1_000_000, 1):
        assert sorted(map(tuple, search.find_in_sentences(q, sim, s, part_rows=rows).collect())) == want
    # with entities: names 1 (cat) and 2 (lay); query 7 needs both a sentence with either and one with name 2
    names = spark.createDataFrame([(1, ["cat"]), (2, ["Cat", "lay"])], "name_id long, ws array<string>")
    wanted = spark.createDataFrame([(7, 1), (7, 2), (8, 1)], "q long, name_id long")
    pairs = spark.createDataFrame([(1, 1, 1.5), (1, 2, 1.2), (2, 2, 1.1)], "name_id long, other long, score double")
    marks = entities.name_marks(s, names)
    ents = wanted.select("q", F.col("name_id").alias("ent"), F.array("name_id").alias("candidates"), F.lit(1.0).alias("gov"))
    posts_e = marks.join(pairs.select(F.col("other").alias("name_id"), F.col("name_id").alias("entity_uid"), "score"), "name_id").select("entity_uid", "sent_uid", "score")
    want = sorted(map(tuple, search.find_similar_sentences(q, sim, posts, ents, posts_e).select("q", "sent_uid", "score", "rank").collect()))
    got = search.find_in_sentences(q, sim, s, names=names, query_names=wanted, pairs=pairs)
    assert want and sorted(map(tuple, got.collect())) == want


def test_numbers_of_sentences_without_their_tokens(spark, tmp_path):
    rows = [(i, "One two. Three\nfour! " * (i % 4), "news") for i in (5, 2, 9, 14, 3, 7)] + [(5, "One. Two. Three. Four. Five. Six. Seven.", "news"), (None, "Last. More.", "news"), (1, None, "news")]
    d = written(spark, tmp_path, documents=(rows, DOCS))
    df = QUERIES["dense_sentence_numbers"](spark, d)
    assert "Generate" not in plan(df)
    got = {r.sent_uid: r.sent_no for r in df.collect()}
    uids = sorted({r[0] for r in tokens.sentence_table(spark.createDataFrame(rows, DOCS)).select("sent_uid").collect()}, key=lambda u: (u is None, u))
    assert got == {u: (1 << 31) + i for i, u in enumerate(uids)} and None in got


def test_similar_documents_by_blocks(spark):
    words = [["all", "red"], ["all", "red", "cat", "cat"], ["all", "cat", f"own{1}"], ["all"], [], ["all", "blue", "dog"], ["all", "dog", "red"]]
    docs = [(i, words[i % 7] + [f"w{i % 11}"] * (i % 3)) for i in range(1, 90)]
    df = spark.createDataFrame(docs, "doc long, words array<string>")
    w = weighting.tfidf(df, "doc", "words").select("doc", "word", F.col("tfidf").alias("w"))
    stated = df.filter("doc % 5 = 0")
    want = sorted(map(tuple, weighting.document_similarity(w, stated.select("doc"), "doc", 4).select("query", "doc", "sim", "rank").collect()))
    for part, frequent in ((1_000_000, 0.05), (5, 0.5), (1_000_000, 2.0)):
        got = weighting.similar_by_words(df, stated, "doc", "words", df.count(), 4, part_rows=part, frequent=frequent)
        assert "Join" not in plan(got)
        assert sorted(map(tuple, got.select("query", "doc", "sim", "rank").collect())) == want


def as_sql(spark, name, d):
    df, c = QUERIES[name](spark, d), duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    want = c.sql(SQL[name]).select(", ".join(df.columns)).fetchall()
    assert want and sorted(map(tuple, df.collect())) == sorted(want)
    return df


def test_sentence_search_hands_on_no_hits(spark, tmp_path):
    df = as_sql(spark, "similar_sentences", written(spark, tmp_path, documents=(ODD, DOCS)))
    assert "MapInArrow" in plan(df) and "Join" not in plan(df)


def test_rows_of_one_sentence_number_are_one_sentence(spark, tmp_path):
    docs = [*ODD, (104, "blue dog runs. red cat.", "news"), (None, "red dog. blue cat runs.", "news"), (None, "red cat runs blue.", "news")]
    got = QUERIES["similar_sentences"](spark, written(spark, tmp_path, documents=(docs, DOCS))).collect()
    assert len({(r.q, r.sent_uid) for r in got}) == len(got)


def test_rows_of_results_from_the_same_search(spark, tmp_path):
    assert "MapInArrow" in plan(as_sql(spark, "result_rows", written(spark, tmp_path, documents=(ODD, DOCS))))


def test_matches_write_no_tokens_of_all_sentences(spark, tmp_path):
    before = len(workspace._made)
    as_sql(spark, "result_matches", written(spark, tmp_path, documents=(ODD, DOCS)))
    assert not [p for _, p in workspace._made[before:] if "textloom-tokens" in p]


def test_annotation_by_parts_of_the_dictionary(spark):
    names = [(1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c"]), (4, ["b", "c"]), (5, ["a", "b"]), (6, ["c", "c"])]
    sents = [(10, list("abcab")), (11, list("aabbc")), (12, []), (13, list("cccc")), (14, list("abxab")), (15, list("bcabcc"))]
    s, n = spark.createDataFrame(sents, "sent_uid long, ws array<string>"), spark.createDataFrame(names, "entity_uid long, ws array<string>")
    trie = entities.build_trie(names)
    want = sorted((k, b, m, tuple(c)) for k, ws in sents for b, m, c in entities.annotate_words(ws, trie))
    for part in (1_000_000, 2, 1):
        got = entities.annotate(s, n, part_names=part)
        assert sorted((r.sent_uid, r.token_pos, r.token_len, tuple(r.candidates)) for r in got.collect()) == want


def test_candidates_are_written_out_once_a_name(spark, tmp_path):
    items = [(i, f"Q{i}", f"Old{i} Lake") for i in range(1, 9)]
    docs = [(i, "see Lake here. the Old3 Lake.", "news") for i in range(4)] + [(5, "Old2 Lake x", "news")]
    df = QUERIES["annotated_entities"](spark, written(spark, tmp_path, documents=(docs, DOCS), wikidata_items=(items, "rec_id long, item_id string, item_label string")))
    above = plan(df).split("Join")[0]
    assert "array_join" not in above and "transform" not in above
    got = sorted((r.sent_uid, r.token_pos, r.token_len, r.candidates) for r in df.collect())
    assert got == [(i * tokens.SENTENCES_PER_CHUNK, 1, 1, "1,2,3,4,5,6,7,8") for i in range(4)] + [(5 * tokens.SENTENCES_PER_CHUNK, 0, 2, "2")]
