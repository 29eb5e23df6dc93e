import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from textloom import session
from textloom.functions import text as X
from textloom.ml import models, weighting
from textloom.operators import importance, tokens
from textloom.sources import readers, writers
from textloom.streaming import flows

DOC = {
    "sentences": [
        {
            "index": 0,
            "tokens": [
                {"index": 1, "word": "Cats", "originalText": "Cats", "pos": "NNS", "characterOffsetBegin": 0, "characterOffsetEnd": 4},
                {"index": 2, "word": "sleep", "originalText": "sleep", "pos": "VBP", "characterOffsetBegin": 5, "characterOffsetEnd": 10},
            ],
            "basicDependencies": [{"dep": "nsubj", "dependent": 1, "governor": 2}, {"dep": "ROOT", "dependent": 2, "governor": 0}],
        }
    ]
}


def test_parser_json(spark):
    df = spark.createDataFrame([(1, json.dumps(DOC)), (2, json.dumps({"sentences": []})), (3, "{broken"), (4, None)], "chunk long, value string")
    t = readers.parsed_tokens(readers.parsed_documents(df), "chunk").orderBy("pos").collect()
    assert [(r.chunk_idx, r.pos, r.word, r.head_pos, r.head_word, r.arc_label, r.beg, r.end) for r in t] == [(1, 0, "Cats", 1, "sleep", "nsubj", 0, 4), (1, 1, "sleep", -1, None, "ROOT", 5, 10)]


def test_batch_parser_text(spark):
    lines = ["Sentence #1 (2 tokens):", "A = b", "[Text== CharacterOffsetBegin=0 CharacterOffsetEnd=1 PartOfSpeech=SYM]", "dobj(A-B-2, ROOT-0)", "punct(가나다-2, ,-6)", "", "Sentence #2 (1 tokens):"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "d int, n int, line string")
    r = readers.batch_sentences(df, "d", "n", "line").orderBy("n").collect()
    assert r[2].token.word == "=" and (r[2].token.beg, r[2].token.end, r[2].token.pos_tag) == (0, 1, "SYM")
    assert (r[3].edge.first, r[3].edge.first_pos, r[3].edge.second_pos) == ("A-B", 1, -1)
    assert (r[4].edge.first_pos, r[4].edge.second, r[4].edge.second_pos) == (1, ",", 5)
    assert [x.sent_no for x in r] == [1] * 6 + [2]


def test_dictionaries_properties_vectors_versions(spark):
    df = spark.createDataFrame([("Q1\tartificial intelligence",), ("Q1\ta\tb",), ("Q2\tP31 Q5 Q6",), ("Q3\tP279 Q7",)], "value string")
    assert ("Q1", ["artificial", "intelligence"]) in [(r.entity, r.ws) for r in readers.entity_names(df).collect()]
    assert sorted((r.entity, r.value) for r in readers.properties(df).collect()) == [("Q2", "Q5"), ("Q2", "Q6")]
    v = spark.createDataFrame([("cat 1 2.5",), ("",)], "value string")
    assert [(r.word, list(r.vec)) for r in readers.vectors(v).collect()] == [("cat", [1.0, 2.5])]
    names = spark.createDataFrame([(f"foo.h5.1.{k}",) for k in (0, 1, 2, 10, 3)] + [("/bar/foo.h5.1.0",), ("/bar/foo.h5.2.1",), ("odd",)], "n string")
    got = {r.base: (r.major, r.minor) for r in readers.latest_version(names, "n").collect()}
    assert got == {"foo.h5": (1, 10), "/bar/foo.h5": (2, 1)}


def test_text_files(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("one\ntwo\n----\nthree\n")
    assert readers.lines(spark, str(p)).count() == 4
    assert readers.whole_files(spark, str(p)).first().value.count("\n") == 4
    assert [r.value.split() for r in readers.separated_documents(spark, str(p), "----\n").collect()] == [["one", "two"], ["three"]]
    x = tmp_path / "a.xml"
    x.write_text("<r><p><t>1</t></p><p><t>2</t></p></r>")
    assert readers.xml_items(spark, str(x), "p").count() == 2
    q = tmp_path / "q.tsv"
    q.write_text("quality\tid1\tid2\ts1\ts2\n1\ta\tb\tx y\tx z\n0\ta\tb\tu\tv\n")
    assert sorted((r.label, r.sent1, r.sent2) for r in readers.paraphrase_pairs(spark, str(q)).collect()) == [(-1, "u", "v"), (1, "x y", "x z")]


def test_markup(spark):
    df = spark.createDataFrame([('<P>a\nb</P><p>c</p><a class="x" href="http://h/1">l</a><A HREF="z">', "<d>Text <table><r>1</r></table> more <b>x</b></d>")], "h string, x string")
    r = df.select(readers.paragraphs(F.col("h")).alias("p"), readers.links(F.col("h"), "h/").alias("l"), readers.description_text(F.col("x")).alias("d")).first()
    assert r.p == ["a\nb", "c"] and r.l == ["http://h/1"] and r.d == "Text more x"
    j = spark.createDataFrame([('{"a":1},',), ("[",), ('{"b":2}',)], "value string")
    assert [r.json for r in readers.json_list_lines(j).collect()] == ['{"a":1}']
    long = spark.createDataFrame([(1, "a longer\r\ntext", "tiny"), (2, None, "another one")], "k int, a string, b string")
    assert sorted((r.k, r.column_name, r.text) for r in readers.long_form(long, "k", ["a", "b"]).collect()) == [(1, "a", "a longer text"), (2, "b", "another one")]
    c = spark.createDataFrame([("x", "9dd4e461268c8034f5c8564e155c67a6"), ("y", "0")], "content string, digest string")
    assert [r.content for r in readers.changed_files(c, "content", "digest").collect()] == ["y"]
    got = readers.parse_remote(spark.createDataFrame([("a\x01b",)], "t string"), "t", lambda ts: [json.dumps({"n": len(t)}) for t in ts]).first()
    assert got.value == '{"n": 3}'


def test_writers(spark, tmp_path):
    t = spark.createDataFrame([(i, i % 3, "w") for i in range(30)], "sent_uid long, token_pos int, word string")
    writers.write_tokens(t, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 30
    writers.write_blocks(t, str(tmp_path / "b"), 3)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 30
    writers.write_tsv(t, str(tmp_path / "v"))
    assert spark.read.text(str(tmp_path / "v")).filter("value like '%\t%'").count() == 30
    writers.convert(t, {"token_pos": "double"}, str(tmp_path / "c"))
    assert dict(spark.read.parquet(str(tmp_path / "c")).dtypes)["token_pos"] == "double"
    s = writers.libsvm_lines(spark.createDataFrame([(1, [0.0, 2.5, 0.0, 1.0])], "y int, v array<double>"), "y", "v")
    assert s.first().value == "1 2:2.5 4:1.0"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a b a\n")
    stream = flows.running_word_counts(spark.readStream.text(str(tmp_path / "in")))
    got = flows.run_to_table(stream, "wc", "complete", str(tmp_path / "cp"))
    assert {r.word: r.n for r in got.collect()} == {"a": 2, "b": 1}
    ev = [("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0), ("2024-01-01 05:00:00", "x", 4.0)]
    df = spark.createDataFrame(ev, "t0 string, k string, v double").withColumn("t0", F.to_timestamp("t0"))
    assert sorted((r.n, r.total) for r in flows.window_counts(df, "t0", "k", "v", "1 hour").collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r.n for r in flows.sessions(df, "t0", "k", "2 hours").collect()) == [1, 2]
    df.write.parquet(str(tmp_path / "ev"))
    s2 = flows.window_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev")), "t0", "k", "v", "1 hour", late="10 minutes")
    late = flows.run_to_table(s2, "wins", "append", str(tmp_path / "cp2")).collect()
    assert [(r.n, r.total) for r in late] == [(2, 3.0)]  # the last window is still open


def test_weights_and_models(spark):
    docs = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b"]), (3, ["c"])], "k int, ws array<string>")
    got = {(r.k, r.word): r.tfidf for r in weighting.tfidf(docs, "k", "ws").collect()}
    assert got[1, "a"] == pytest.approx(2 * np.log(3)) and got[2, "b"] == pytest.approx(np.log(1.5))
    pairs = spark.createDataFrame([(1, ["a", "x"], ["a", "y"])] * 5 + [(-1, ["a", "z"], ["b", "z"])] * 5, "label int, words1 array<string>, words2 array<string>")
    w = {r.word: r.weight for r in weighting.kld_weights(pairs).collect()}
    assert w["a"] > 1 and w["a"] > w["x"] >= 0 and w["b"] >= 0
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 6)) + rng.normal(size=(60, 6)) * 0.01
    e = spark.createDataFrame([(i, r.tolist(), 1 if r[0] > 0 else -1) for i, r in enumerate(x)], "k int, v array<double>, y int")
    latent, s, right = models.latent_space(e, "k", "v", 2)
    assert np.allclose(s, np.linalg.svd(x)[1][:2], rtol=1e-6)
    got = {r.k: np.array(r.latent) for r in latent.collect()}
    assert np.allclose(got[3], x[3] @ right, atol=1e-9)
    assert models.principal_components(e, "k", "v", 2).count() == 60
    m = models.train_svm(e, "y", "v")
    right_ones = e.select("y", models.svm_score(m, F.col("v")).alias("s")).filter("y * s > 0").count()
    assert right_ones >= 57
    b = models.orthonormal_basis([[1, 0, 0], [2, 0, 0], [1, 1, 0]])
    assert len(b) == 2 and np.allclose(b @ b.T, np.eye(2)) and np.allclose(models.project(np.array([3.0, 4.0, 5.0]), b), [3, 4, 0])
    y = models.embed_plane(np.concatenate([rng.normal(size=(15, 5)), rng.normal(size=(15, 5)) + 12]), perplexity=5, steps=150)
    near = np.linalg.norm(y[:15] - y[:15].mean(0), axis=1).mean()
    assert np.linalg.norm(y[:15].mean(0) - y[15:].mean(0)) > 2 * near


def test_word_vectors(spark):
    s = spark.createDataFrame([(["cat", "sat", "mat"] * 4,), (["dog", "ran", "far"] * 4,)] * 5, "ws array<string>")
    assert models.word_vectors(s, "ws", size=8, min_count=2).count() == 6
    pairs = pd.DataFrame({"word": [0, 1, 2, 3] * 50, "context": [1, 0, 3, 2] * 50})
    v = models.negative_sampling(spark.createDataFrame(pairs), np.array([50, 50, 50, 50]), size=8, epochs=4, rate=0.1)
    assert v.shape == (4, 8) and np.isfinite(v).all() and np.abs(v).sum() > 0


def test_session(spark):
    docs = spark.createDataFrame([(1, "The cat sat here."), (2, "A dog ran. The cat sat here."), (3, "Nothing.")], "doc_id long, text string")
    sents = tokens.sentence_table(docs)
    imp = spark.createDataFrame([("cat", 0.8), ("sat", 0.7), ("dog", 0.9)], "word string, score double")
    s = session.Session(spark, tokens.token_table(sents), sents, imp)
    uids = s.register("The cat sat")
    assert uids == [session.FIRST_QUERY] and s.register("The cat sat") == uids and s.register("  ") == []
    rows = s.ask([*uids, 99]).collect()
    assert [(r.sentence, r.rank) for r in rows] == [("The cat sat here.", 1)]
    assert json.loads(s.handle(json.dumps({"ask": "The cat sat"})))["results"][0]["input_uid"] == uids[0]
    assert s.handle("nonsense") == "null" == s.handle('{"ask": ""}') == s.handle("[1]")
    d = spark.createDataFrame([("China", 1)], "word string, ord int")
    assert s.preprocess("china cat", d).first().corrected == "China cat"
    p = spark.createDataFrame([(1, 0, ["red", "cat"], 2.0), (2, 0, ["red", "cat"], 2.0)], "sent_uid long, phrase_no int, ws array<string>, score double")
    assert [r.suggestion for r in s.suggest(["cat"], p).collect()] == ["red cat"]


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).columns
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    assert importance.NOISY_BELOW == 0.6 and X.UNKNOWN == "-UNKNOWN-"
