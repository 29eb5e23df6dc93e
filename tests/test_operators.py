import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import depgraph, entities, importance, nested, ranking, render, search, similarity, tokens, vocabulary

NAMES = [(1, [5]), (2, [7, 8]), (3, [1, 2, 3]), (33, [1, 2, 3])]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_annotation_rule():
    trie = entities.build_trie([("five", [5]), ("long", [5, 6, 8]), ("pair", [7, 8])])
    assert entities.annotate_words([5, 6, 7], trie) == []  # never falls back to the shorter name at once: 5 6 has no name
    assert entities.annotate_words([5, 9, 5], trie) == [(0, 1, ["five"]), (2, 1, ["five"])]
    assert entities.annotate_words([5, 6, 8, 7, 8], trie) == [(0, 3, ["long"]), (3, 2, ["pair"])]
    assert entities.annotate_words([5, 6], trie) == [] and entities.annotate_words([], trie) == []


def naive(ws, names):
    out, at = [], 0
    while at < len(ws):
        k = 0
        while at + k < len(ws) and any(n[: k + 1] == ws[at : at + k + 1] for _, n in names):
            k += 1
        uids = sorted({u for u, n in names if n == ws[at : at + k]}) if k else []
        if uids:
            out.append((at, k, uids))
            at += k
        else:
            at += 1
    return out


WORD = st.sampled_from("abc")


@settings(max_examples=200, deadline=None)
@given(st.lists(WORD, max_size=12), st.lists(st.tuples(st.integers(1, 5), st.lists(WORD, min_size=1, max_size=3)), max_size=6))
def test_annotation_against_naive_model(ws, names):
    assert entities.annotate_words(ws, entities.build_trie(names)) == naive(ws, names)


def test_annotation_of_tables_by_trie_and_by_join(spark):
    names = [(1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c"]), (4, ["b", "c"]), (5, ["a", "b"])]
    sents = [(10, list("abcab")), (11, list("aabbc")), (12, []), (13, list("cccc")), (14, list("abxab"))]
    s = spark.createDataFrame(sents, "sent_uid long, ws array<string>")
    n = spark.createDataFrame(names, "entity_uid long, ws array<string>")
    want = sorted((k, b, m, tuple(c)) for k, ws in sents for b, m, c in naive(ws, names))
    for df in (entities.annotate(s, n), entities.annotate_by_join(s, n)):
        assert sorted((r.sent_uid, r.token_pos, r.token_len, tuple(r.candidates)) for r in df.collect()) == want


def test_overlap_equality_and_containment(spark):
    df = spark.createDataFrame([([0, 1, 2], [0, 5], [2, 11])], "a array<int>, b array<int>, c array<int>")
    r = df.select(entities.same_entity(F.col("a"), F.col("b")).alias("ab"), entities.same_entity(F.col("a"), F.col("c")).alias("ac"), entities.same_entity(F.col("b"), F.col("c")).alias("bc")).first()
    assert (r.ab, r.ac, r.bc) == (True, True, False)
    t = spark.createDataFrame([([[1, 2], [3]], [[2], [3, 4]]), ([[1], [9]], [[1]])], "e array<array<int>>, t array<array<int>>")
    assert [x.v for x in t.select(entities.contains_all(F.col("e"), F.col("t")).alias("v")).collect()] == [True, False]


def test_named_entities_and_votes(spark):
    names = spark.createDataFrame([(1, ["artificial", "intelligence"]), (1, ["AI"]), (2, ["Google"]), (3, ["x", "y"])], "entity_uid long, ws array<string>")
    listed = spark.createDataFrame([(3,)], "entity_uid long")
    assert rows(entities.named_entities(names, listed), "entity_uid", "named") == [(1, True), (2, False), (3, True)]
    v = spark.createDataFrame([("a", True)] + [("a", False)] * 4 + [("b", True)] + [("b", False)] * 5, "k string, f boolean")
    assert rows(entities.class_vote(v, "k", "f"), "k", "yes", "no", "vote") == [("a", 1, 4, True), ("b", 1, 5, False)]
    t = spark.createDataFrame([("a", "PER"), ("a", "PER"), ("b", "PER"), ("b", "O")], "k string, tag string")
    assert rows(entities.all_tagged(t, "k", "tag"), "k", "named") == [("a", True), ("b", False)]


def test_false_entities_instances_and_heads(spark):
    a = spark.createDataFrame([(1, 0, 2, [5, 6]), (1, 3, 1, [7]), (1, 4, 1, [8]), (2, 0, 3, [9])], "sent_uid long, token_pos int, token_len int, candidates array<long>")
    named = spark.createDataFrame([(6,)], "entity_uid long")
    nouns = spark.createDataFrame([(1, 3)], "sent_uid long, token_pos int")
    assert rows(entities.keep_true_entities(a, named, nouns), "sent_uid", "token_pos", "candidates") == [(1, 0, [6]), (1, 3, [7])]
    p = spark.createDataFrame([(5, 1, 0.5)], "entity_uid long, sent_uid long, score double")
    inst = spark.createDataFrame([(5, 50), (5, 51)], "entity_uid long, class_uid long")
    names = spark.createDataFrame([(50, ["firm"])], "entity_uid long, ws array<string>")
    assert rows(entities.with_instances(p, inst, names), "entity_uid", "sent_uid") == [(5, 1), (50, 1)]
    t = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, -1)], "sent_uid long, pos int, head_pos int")
    s = spark.createDataFrame([(1, 0, 2), (1, 0, 3)], "sent_uid long, token_pos int, token_len int")
    assert rows(entities.span_heads(s, t), "token_len", "head_token") == [(2, 1), (3, 2)]


def test_country_tags(spark):
    names = ["South Korea", "China", "Japan", "Hong Kong"]
    df = spark.createDataFrame([("In South Korea.",), ("In Korea.",), ("China is in Asia.",)], "t string")
    got = [set(r.tags) for r in entities.country_tags(df, "t", names, {"Korea": "South Korea", "China": "Hong Kong"}).collect()]
    assert got == [{"South Korea"}, {"South Korea"}, {"China", "Hong Kong"}]


def test_importance(spark):
    curve = spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "r double").select(importance.score(F.col("r")).alias("s"))
    assert [r.s for r in curve.collect()] == pytest.approx([0.0, 0.9 * (1 - 1 / 1.001), 0.6001], abs=1e-4)
    pairs = spark.createDataFrame([(["a", "a", "b"], ["a", "c"])] * 6 + [(["b"], ["c"])], "summary_words array<string>, full_words array<string>")
    got = {r.word: (r.summary, r.full, r.both) for r in importance.contingency(pairs).collect()}
    assert got == {"a": (6, 6, 6), "b": (7, 0, 0), "c": (0, 7, 0)}
    t = {r.word: r.ratio for r in importance.importance_table(pairs).collect()}
    assert t["a"] == pytest.approx(6 * 7 / 36) and t["b"] == 0.0
    o = spark.createDataFrame([("Japan", 0.2)], "w string, r double").select(importance.override(F.col("w"), F.col("r"), ["Japan"]).alias("x")).first().x
    assert o == 3.1


def test_vocabulary(spark):
    a = spark.createDataFrame([("x",), ("y",)], "word string")
    b = spark.createDataFrame([("y",), ("z",)], "word string")
    known, unseen = vocabulary.known_and_unseen(a, b)
    assert rows(known, "word") == [("y",)] and rows(unseen, "word") == [("x",)]
    xs = [1, 2, 4, 5, 6, 7, 8, 10]
    ys = [1, 3, 4, 6, 7, 8, 9, 11]
    w = lambda v: spark.createDataFrame([(str(i),) for i in v], "word string")
    k, u = vocabulary.known_and_unseen(w(xs), w(ys))
    assert {int(r.word) for r in k.collect()} == {1, 4, 6, 7, 8} and {int(r.word) for r in u.collect()} == {2, 5, 10}
    keep = spark.createDataFrame([(0.0001,), (0.1,)], "p double").select(vocabulary.subsample_keep(F.col("p"), 0.001).alias("k"))
    assert [r.k for r in keep.collect()] == pytest.approx([(math.sqrt(0.1) + 1) / 0.1, (math.sqrt(100) + 1) / 100])
    t = spark.createDataFrame([("x", "1")], "word string, v string")
    assert rows(vocabulary.with_default(a, t, "word", "v", "-UNKNOWN-"), "word", "v") == [("x", "1"), ("y", "-UNKNOWN-")]


def test_rank_cuts(spark):
    df = spark.createDataFrame([("q", i, s) for i, s in enumerate([10.0, 6.0, 5.0, 4.0, 6.0])] + [("r", 9, 1.0)], "q string, id int, s double")
    assert rows(ranking.half_cut(df, "q", 3, "s", "id"), "q", "id") == [("q", 0), ("q", 1), ("q", 4), ("r", 9)]
    assert ranking.top_n(df, 99, "s", "id").count() == 6
    c = spark.createDataFrame([("q", 1, 9.0), ("q", 1, 8.0), ("q", 2, 7.0), ("q", 1, 6.5), ("q", 3, 6.0), ("q", 4, 1.0)], "q string, chunk int, s double")
    assert rows(ranking.unique_chunk_cut(c, "q", "chunk", 2, "s"), "chunk", "s") == [(1, 8.0), (1, 9.0), (2, 7.0)]
    assert rows(ranking.max_per_key(df, ["q"], "s", ["id"]), "q", "s", "id") == [("q", 10.0, 0), ("r", 1.0, 9)]
    b = spark.createDataFrame([("x", 1.0, 1), ("x", 2.0, 2), ("y", 1.0, 3)], "k string, s double, id int")
    assert rows(ranking.bag_dedup(b, "k", "s", "id"), "id") == [(2,), (3,)]
    v = spark.createDataFrame([("a", 1, 9), ("a", 2, 0), ("b", 0, 1)], "k string, major int, minor int")
    assert rows(ranking.newest(v, "k", "major", "minor"), "k", "major") == [("a", 2), ("b", 0)]


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "A b. C d!\n\nE"), (2, None), (3, "")], "doc_id long, text string")
    s = tokens.sentence_table(docs)
    assert rows(s, "sent_uid", "sentence") == [(1000000, "A b."), (1000001, "C d!"), (1000002, "E")]
    t = tokens.token_table(s)
    assert rows(t, "sent_uid", "pos", "word", "head_pos")[:2] == [(1000000, 0, "A", 1), (1000000, 1, "b.", -1)]
    assert rows(tokens.dense_sentence_uid(t, 5).select("sent_uid", "sent_no").distinct(), "sent_no") == [(5,), (6,), (7,)]
    c = tokens.context_pairs(t, 2)
    assert rows(c, "word", "context") == [("A", "b."), ("C", "d!"), ("b.", "A"), ("d!", "C")]
    e = spark.createDataFrame([(1, i, k) for i, k in enumerate("aabba")], "g int, i int, k string")
    assert rows(tokens.consecutive_ranges(e, "k", "i", "g"), "begin", "end", "k") == [(0, 2, "a"), (2, 4, "b"), (4, 5, "a")]


def test_search_with_entities(spark):
    sim = spark.createDataFrame([("cat", "cat", 1.0), ("cat", "Cat", 0.9), ("sat", "sat", 1.0)], "word string, sim_word string, similarity double")
    posts = spark.createDataFrame([("cat", 1, "sat"), ("Cat", 2, "lay"), ("cat", 3, None)], "word string, sent_uid long, head_word string")
    q = spark.createDataFrame([(7, 0, "cat", 0.8, "sat", 0.5), (7, 1, "the", 0.1, "cat", 0.8)], "q long, q_pos int, word string, score double, head_word string, head_score double")
    got = rows(search.find_similar_sentences(q, sim, posts), "q", "sent_uid", "score")
    assert got == [(7, 1, 1.2), (7, 2, 0.72), (7, 3, 0.8)]
    ents = spark.createDataFrame([(7, 0, [5, 6], 1.0), (7, 1, [9], 2.0)], "q long, ent int, candidates array<long>, gov double")
    ep = spark.createDataFrame([(5, 1, 0.5), (6, 1, 0.7), (9, 1, 0.1), (5, 3, 0.5)], "entity_uid long, sent_uid long, score double")
    got = rows(search.find_similar_sentences(q, sim, posts, ents, ep), "sent_uid", "score")
    assert got == [(1, 2.1)]  # sentence 3 lacks an entity
    none = spark.createDataFrame([], "q long, ent int, candidates array<long>, gov double")
    assert search.find_similar_sentences(q, sim, posts, none, ep).count() == 0


def test_trees_of_sentences(spark):
    heads, w = [1, -1, 1], [1.0, 2.0, 3.0]
    assert depgraph.subtree_sums(heads, w) == [1.0, 6.0, 3.0]
    assert depgraph.fragility(heads, w) == [1.0 * (6 - 1) / 1, 6.0 * (0 - 2) / 2, 3.0 * (6 - 3) / 3]
    assert depgraph.phrases(heads, w, cutoff=4.0) == [[0], [1, 2]]
    assert depgraph.phrases(heads, w, cuts=2) == [[0], [1], [2]]
    assert depgraph.phrases([1, -1], [0.0, 2.0], cutoff=1e9) == [[0, 1]]
    assert depgraph.phrases([-1, 0], [2.0, 0.0], cutoff=1.0) == [[0, 1]]
    assert depgraph.root_path([1, 2, -1], 0) == [0, 1, 2] and depgraph.subtree_sums([1, 0], [1.0, 1.0])
    p = spark.createDataFrame([(1, 0, ["red", "cat"], 2.0), (2, 0, ["cat", "red"], 2.0), (3, 0, ["cat"], 1.0), (4, 0, ["cat", "sat", "down"], 3.0)], "sent_uid long, phrase_no int, ws array<string>, score double")
    ideas = spark.createDataFrame([("cat",)], "word string")
    assert rows(depgraph.suggest(p, ideas), "idea", "suggestion", "n", "rank") == [("cat", "cat red", 2, 0)]


def test_clips_and_json(spark):
    begs, ends = [0, 4, 8, 12, 16], [3, 7, 11, 15, 19]
    assert render.clip([(1.0, 8, 11)], begs, ends, 11) == (4, 15)
    assert render.clip([(1.0, 8, 11), (0.5, 0, 3)], begs, ends, 100) == (0, 19)
    assert render.clip([(1.0, 0, 3), (0.9, 16, 19)], begs, ends, 8) == (0, 7)
    assert render.clip([], [], [], 5) == (0, 0)
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "q int, rank int, t string")
    assert json.loads(render.as_json(df, "q", "rank", ["rank", "t"]).first().result_json) == {"rank": [1, 2], "t": ["a", "b"]}
    w = spark.createDataFrame([(0, i, x, 0.0 if x != "safety" else 1.0) for i, x in enumerate("china safety rohs zzz".split())], "k int, pos int, word string, score double")
    d = spark.createDataFrame([("CHINA", 1), ("China", 2), ("RoHS", 3)], "word string, ord int")
    assert render.did_you_mean(w, d, "k").first().corrected == "China safety RoHS zzz"
    m = spark.createDataFrame([(1, 0.5, 0, 2, 5, 7), (1, 0.9, 0, 2, 1, 3), (1, 0.0, 0, 1, 0, 1)], "k int, score double, q_beg int, q_end int, beg int, end int")
    assert [x.score for x in render.score_list(m, ["k"]).first().scores_with_offset] == [0.9, 0.5]


def test_vectors_of_tables(spark):
    e = spark.createDataFrame([(i, [float(i), 1.0, 0.0], i % 2) for i in range(6)], "id long, v array<double>, label int")
    n = similarity.nearest(e.filter("id = 0"), e, "id", "v", 2)
    assert rows(n, "query", "id", "rank") == [(0, 1, 1), (0, 2, 2)]
    assert rows(similarity.similar_table(e.filter("id = 0"), e, "id", "v", 0.5), "id") == [(0,), (1,)]
    c = {r.label: list(r.centroid) for r in similarity.centroids(e, "label", "v").collect()}
    assert c[0] == pytest.approx([2.0, 1.0, 0.0]) and c[1] == pytest.approx([3.0, 1.0, 0.0])
    s = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", 1.0)], "k string, x double")
    assert rows(similarity.second_largest(s, "k", "x"), "k", "x") == [("a", 2.0)]
    ctx = spark.createDataFrame([("new", "p"), ("new", "p"), ("new", "q"), ("new", "zz")], "word string, context string")
    vec = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 3.0])], "word string, vec array<double>")
    assert list(similarity.context_vectors(ctx, vec).first().centroid) == pytest.approx([2 / 3, 1.0])


LINE = {
    "id": "Q1",
    "labels": {"en": {"language": "en", "value": "x"}, "de": None, "fr": "plain"},
    "aliases": {"en": [{"language": "en", "value": "y"}, None], "fr": {"language": "fr", "value": "z"}},
    "claims": {"P1": [{"mainsnak": {"property": "P1"}, "qualifiers": {"P2": [{"property": "P2", "snaktype": "value"}]}, "references": [{"hash": "h", "snaks": {"P3": [{"property": "P3", "snaktype": "value"}]}}, {"snaks": []}]}, {"mainsnak": {}, "qualifiers": [{"property": "P4", "snaktype": "value"}], "references": None}]},
}
PATHS = {
    ("label", "labels/en"), ("label", "labels/fr"), ("alias", "aliases/en/0"), ("alias", "aliases/fr"), ("claim", "claims/P1/0"), ("claim", "claims/P1/1"),
    ("qualifier", "claims/P1/0/qualifiers/P2/0"), ("qualifier", "claims/P1/1/qualifiers/0"), ("reference", "claims/P1/0/references/0"),
    ("reference", "claims/P1/0/references/1"), ("refsnak", "claims/P1/0/references/0/snaks/P3/0"),
}


def test_nested_records(spark):
    text = json.dumps(LINE)
    lines = [(1, "["), (2, text + ","), (3, "  " + text + " ,"), (4, text[:-9]), (5, None), (6, ""), (7, "]"), (8, '{"labels": [], "claims": []}'), (9, "[1, 2]"), (10, '"x"')]
    got = nested.nodes(spark.createDataFrame([(i, t, 0, "x") for i, t in lines], "line_no long, raw_line string, pre int, kind string"))
    assert {(r.kind, r.node_path) for r in got.collect() if r.line_no == 2} == PATHS
    assert {r.line_no for r in got.collect()} == {2, 3}
    by = {r.node_path: r for r in got.filter("line_no = 2").collect()}
    for a in by.values():
        for b in by.values():
            below = b.node_path.startswith(a.node_path + "/")
            assert below == (a.pre < b.pre and b.post < a.post), (a, b)
    links = nested.link(nested.kind_table(got, "claim"), nested.kind_table(got, "refsnak"), "claim")
    assert {(r.node_path, r.claim_path) for r in links.collect()} == {("claims/P1/0/references/0/snaks/P3/0", "claims/P1/0")}


def test_nested_records_that_are_long_or_none(spark):
    big = {"labels": {f"l{i}": {"language": f"l{i}", "value": "v" * 50} for i in range(5000)}}
    df = spark.createDataFrame([(1, json.dumps(big))], "line_no long, raw_line string")
    assert nested.nodes(df).count() == 5000
    assert nested.nodes(df.limit(0)).count() == 0
