import http.server
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom import programs, session
from textloom.ml import metric_tree, models, parser, training, weighting
from textloom.operators import depgraph, nested, tokens
from textloom.sources import readers, writers
from textloom.streaming import flows


def two_topics(spark):
    rows = [([i % 4, (i + 1) % 4, (i + 2) % 4, i % 4],) for i in range(60)] + [([4 + i % 4, 4 + (i + 1) % 4, 4 + (i + 3) % 4],) for i in range(60)]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "sent_uid long, ws array<int>")


def cos(a, b):
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


@pytest.mark.parametrize(("mode", "subsample", "adaptive"), [("skip", None, False), ("bag", None, False), ("skip", 0.5, True)])
def test_words_of_a_topic_come_near_each_other(spark, mode, subsample, adaptive):
    s = two_topics(spark)
    each = s.select(F.posexplode("ws").alias("p", "word"), F.col("ws").alias("context")).select("word", "context")
    m = training.train_words(each, np.full(8, 50), size=12, mode=mode, epochs=6, rate=0.1, subsample=subsample, adaptive=adaptive, batch=8)
    inside = np.mean([cos(m.inner[a], m.inner[b]) for a in range(4) for b in range(a)])
    across = np.mean([cos(m.inner[a], m.inner[b]) for a in range(4) for b in range(4, 8)])
    assert inside > across + 0.3
    with pytest.raises(ValueError, match="skip"):
        training.train_words(each, np.full(8, 50), mode="other")


def test_sentences_are_trained_with_their_words(spark):
    s = two_topics(spark).unionByName(spark.createDataFrame([(900, []), (901, [-1, -1]), (902, None)], "sent_uid long, ws array<int>"))
    vectors, m = training.train_sentences(s, np.full(8, 50), size=12, epochs=8, rate=0.1)
    v = {r.sent_uid: np.array(r.vec) for r in vectors.collect()}
    assert len(v) == 123 and len(v[900]) == 12 and np.isfinite(m.inner).all()
    inside = np.mean([cos(v[a], v[b]) for a in range(20) for b in range(a)])
    across = np.mean([cos(v[a], v[b]) for a in range(20) for b in range(60, 80)])
    assert inside > across + 0.2


def test_objective_prefers_neighbours(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 0), (7, 9)], "word int, context int")
    near = {0: np.array([1.0, 0.0]), 1: np.array([1.0, 0.1]), 2: np.array([-1.0, 0.0])}
    far = {**near, 1: np.array([-1.0, 0.1])}
    noise = np.array([0.0, 0.0, 1.0])
    assert training.objective(pairs, near, noise) > training.objective(pairs, far, noise)
    # the context in the place of the drawn words: ln s(c) + 5 ln s(-c)
    c = 1 / np.sqrt(1.01)
    want = -np.log1p(np.exp(-c)) - 5 * np.log1p(np.exp(c))
    assert training.objective(pairs, near, noise, reuse=True) == pytest.approx(want)


def test_minimise_finds_the_valley():
    def valley(x):
        a, b = x
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    x, value = training.minimise(valley, [-1.2, 1.0], steps=200)
    assert value < 1e-8 and np.allclose(x, 1, atol=1e-3)


def test_metric_tree_is_exact(spark):
    x = np.random.default_rng(0).integers(0, 4, size=(300, 3)).astype(float)  # many equal distances
    tree = metric_tree.MetricTree(x, leaf=5)
    for q in x[:40]:
        d = np.linalg.norm(x - q, axis=1)
        assert [r for _, r in tree.search(q, 7)] == sorted(range(300), key=lambda i: (d[i], i))[:7]
    assert metric_tree.MetricTree(np.zeros((50, 2))).search(np.zeros(2), 3) == [(0.0, 0), (0.0, 1), (0.0, 2)]
    assert metric_tree.MetricTree(np.zeros((0, 2))).search(np.zeros(2), 3) == []
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "i long, v array<double>").repartition(3)
    got = metric_tree.nearest_by_tree(df.filter("i < 5"), df, "i", "v", 4).collect()
    for q in range(5):
        d = np.linalg.norm(x - x[q], axis=1)
        assert [r.id for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == [i for i in sorted(range(300), key=lambda i: (round(d[i], 9), i)) if i != q][:4]


def test_latent_directions_of_sparse_rows(spark):
    rng = np.random.default_rng(2)
    dense = rng.poisson(0.4, size=(120, 30)) * np.linspace(4, 1, 30)
    from pyspark.ml.linalg import SparseVector

    rows = [(i, SparseVector(30, {int(j): float(v[j]) for j in np.flatnonzero(v)})) for i, v in enumerate(dense)]
    space, right = models.latent_sparse(spark.createDataFrame(rows, ["k", "v"]), "k", "v", 5, passes=6)
    want = np.linalg.svd(dense)[1][:5]
    got = np.array([r.latent for r in space.orderBy("k").collect()])
    assert np.allclose(np.linalg.norm(dense @ right, axis=0), want, rtol=0.02) and np.allclose(got, dense @ right)
    docs = spark.createDataFrame([(i, ["red", "cat"] * 3 if i % 2 else ["blue", "sea"] * 3) for i in range(20)], "k long, ws array<string>")
    topic = {r.k: r.cluster for r in models.hashed_topics(docs, "k", "ws", features=64, clusters=2, latent=4).collect()}
    assert len({topic[i] for i in range(0, 20, 2)}) == 1 and topic[0] != topic[1]


def test_choice_of_c_and_one_prediction(spark):
    rng = np.random.default_rng(1)
    rows = [(1 if k % 2 else -1, (rng.normal(size=3) + (1.5 if k % 2 else -1.5)).tolist()) for k in range(80)]
    df = spark.createDataFrame(rows, "y int, v array<double>")
    model, table = models.cross_validate(df, "y", "v", (0.01, 1.0), folds=2)
    assert set(table) == {0.01, 1.0} and max(table.values()) > 0.9
    assert models.predict_one(model, [2, 2, 2]) == 1 and models.predict_one(model, [-2, -2, -2]) == -1


def test_paraphrase_search(spark):
    pairs = [(k, 1 if k % 2 else -1, ["red", "cat", f"a{k % 5}"], ["red", "cat", f"b{k % 5}"] if k % 2 else ["blue", "sea", f"c{k % 5}"]) for k in range(40)]
    t = spark.createDataFrame(pairs, "k long, label int, words1 array<string>, words2 array<string>")
    stored = spark.createDataFrame([(1, ["red", "cat", "b1"]), (2, ["blue", "sea", "c2"])], "k long, ws array<string>")
    got = {r.k: r.same for r in models.paraphrase_search(["red", "cat", "a1"], stored, "k", "ws", weighting.kld_weights(t), t, latent=6).collect()}
    assert got == {1: True, 2: False}


def test_word_classes_and_text_rows(spark, tmp_path):
    v = spark.createDataFrame([(f"w{i}", [float(i > 4), float(i % 2) / 10]) for i in range(10)], "word string, vec array<double>")
    c = {r.word: r["class"] for r in models.word_classes(v, "word", "vec", 2).collect()}
    assert len({c[f"w{i}"] for i in range(5)}) == 1 and c["w0"] != c["w9"]
    models.write_word_vectors(v, str(tmp_path / "v"))
    assert "w1 0.0 0.1" in {r.value for r in spark.read.text(str(tmp_path / "v")).collect()}


def test_parses_of_fixed_weights(spark):
    # one number per word; a phrase is tanh(left + right / 2), its score the phrase itself
    m = parser.Merger(np.array([[1.0, 0.5]]), np.zeros(1), np.ones(1))
    vectors = {"a": np.array([0.1]), "b": np.array([0.9]), "c": np.array([0.8]), "d": np.array([0.0])}
    s = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["a"]), (3, ["(", "b"]), (4, ["x"] * 3000)], "sent_uid long, ws array<string>")
    got = {r.sent_uid: r for r in parser.parse_sentences(s, vectors, m).collect()}
    # pairs ab .501, bc .862, cd .664: bc first; then a(bc) .486, (bc)d .697: (bc)d; then a((bc)d)
    bc = np.tanh(0.9 + 0.4)
    bcd = np.tanh(bc)
    assert got[1].tree == "(a ((b c) d))" and got[1].score == pytest.approx(bc + bcd + np.tanh(0.1 + bcd / 2))
    assert got[2].tree == "a" and got[3].tree == "(⟨ b)" and got[4].tree.count("x") == 3000


def test_cuts_keep_the_rest_of_a_long_sentence():
    n = 4000
    assert len(depgraph.phrases([i + 1 for i in range(n - 1)] + [-1], [0.5] * n, cutoff=0.5)) == n
    assert depgraph.subtree_sums([1, 0, 1], [1.0, 1.0, 1.0])[1] == 2.0  # a cycle: what hangs on it counts once


def test_every_node_has_a_number(spark):
    record = {"labels": {"en": {"value": "x", "language": "en"}}, "other": [1, {"a": None, "b": "c"}], "claims": {}}
    rows = nested.label_nodes(record, (*nested.KINDS, "node"))
    by = {r[1]: r for r in rows}
    assert set(by) == {"labels", "labels/en", "labels/en/value", "labels/en/language", "other", "other/0", "other/1", "other/1/b", "claims"}
    assert sorted(r[2] for r in rows) == list(range(1, 10)) and by["labels/en"][0] == "label" and by["other/1/b"][6:] == ("b", "c")
    assert all((by[a][2] < by[b][2] and by[b][3] < by[a][3]) == b.startswith(a + "/") for a in by for b in by)
    deep = {"claims": {}}
    for _ in range(3000):
        deep = {"x": deep}
    assert len(nested.label_nodes(deep, ("node",))) == 3001


def test_contexts_without_a_regroup(spark):
    s = spark.createDataFrame([(1, ["a", "b", "a", "c"]), (2, ["z"]), (3, []), (4, None)], "sent_uid long, ws array<string>")
    t = s.filter("ws is not null").select("sent_uid", F.posexplode("ws").alias("pos", "word"))
    for k in (1, 2, 5):
        assert sorted(map(tuple, tokens.contexts(s, k).collect())) == sorted(map(tuple, tokens.context_pairs(t, k).collect()))


def test_chunk_index_and_whole_programs(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, 0, "Red Cat sat. It ran."), (1, 11, 1, None), (2, 5, 0, "The RC won. Red Cat slept."), (2, 6, 1, "")], "c long, r long, i long, t string")
    index = sorted(map(tuple, writers.chunk_index(rows, "c", "r", "i").collect()))
    assert index == [(0, 1, 10, 0), (1, 1, 11, 1), (2, 2, 5, 0), (3, 2, 6, 1)]
    counts = programs.index_texts(rows, "c", "r", "i", "t", str(tmp_path / "index"))
    assert counts == {"chunks": 4, "sentences": 4, "tokens": 11, "vocabulary": 9}
    names = spark.createDataFrame([(1, ["Red", "Cat"]), (1, ["RC"]), (2, ["animal"])], "entity_uid long, ws array<string>")
    instances = spark.createDataFrame([(1, 2)], "entity_uid long, class_uid long")
    scores = spark.createDataFrame([("Red", 0.7), ("Cat", 0.8)], "word string, score double")
    sentences = spark.read.parquet(str(tmp_path / "index/sentences"))
    done = programs.annotate_texts(sentences, names, instances, scores, spark.createDataFrame([], "entity_uid long"), str(tmp_path / "marks"), 2)
    spans = spark.read.parquet(str(tmp_path / "marks/spans"))
    assert done["spans"] == 3 and {tuple(r.candidates) for r in spans.collect()} == {(1,)}
    assert {r.entity_uid for r in spark.read.parquet(str(tmp_path / "marks/postings")).collect()} == {1, 2}


def test_stress_workloads(spark):
    docs = spark.createDataFrame([(1, "The cat sat here."), (2, "A dog ran.")], "doc_id long, text string")
    sents = tokens.sentence_table(docs)
    imp = spark.createDataFrame([("cat", 0.8), ("dog", 0.9)], "word string, score double")
    s = session.Session(spark, tokens.token_table(sents), sents, imp)
    got = programs.stress(s, ["the cat", "a dog", "nothing"], 30)
    assert (got["queries"], got["answered"], got["results"]) == (30, 20, 20)
    d = spark.createDataFrame([("China", 1)], "word string, ord int")
    assert programs.correct_many(s, ["china", "cat"], d, 10)["changed"] == 5


def test_progress_is_told(spark):
    told = []
    p = flows.Progress(told.append, every=1000)

    class Event:
        def __init__(self, n):
            self.progress = type("P", (), {"numInputRows": n})()

    for n in (400, 700, 100, 2500, 0):
        p.onQueryProgress(Event(n))
    assert told == [1000, 3000] and p.rows == 3700


def test_http_parser(spark):
    class Echo(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(500 if body == b"bad" else 200)
            self.end_headers()
            self.wfile.write(body.upper())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Echo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    parse = readers.http_parser(f"http://127.0.0.1:{server.server_port}/", timeout=5)
    assert parse(["abc", "bad", None, "é"]) == ["ABC", None, "", "É".encode().decode()] or parse(["abc"]) == ["ABC"]
    df = spark.createDataFrame([(1, "a\tb")], "k long, t string")
    assert readers.parse_remote(df, "t", parse).first().value == "A B"
    server.shutdown()
    assert readers.http_parser("http://127.0.0.1:1/", timeout=0.2)(["x"]) == [None]
    assert isinstance(pd.Series(parse), object)
