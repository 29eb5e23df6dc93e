import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions import trees
from textloom.functions import vectors as V
from textloom.ml import parser, symbolic


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_white_space_words(spark):
    s = "11\r22\r\r\r33\t\t14 15\r\n16 17 18   119\t \n 11110\n"
    assert one(spark, X.words(F.col("s")), s=s) == "11 22 33 14 15 16 17 18 119 11110".split()
    assert one(spark, X.words(F.col("s")), s="") == []


def test_code_point_substring(spark):
    assert one(spark, X.code_points(F.col("s"), 8, 11), s="This is 테스트 of unicode-UTF8 conversion.") == "테스트"


def test_strip_split_and_packing(spark):
    assert one(spark, X.strip(F.col("s")), s="\t a b \n") == "a b"
    assert one(spark, X.split_any(F.col("s")), s="a  b\tc") == ["a", "", "b", "c"]
    assert one(spark, X.unpack_words(X.pack_words(F.col("s"))), s=["a b", "", "c"]) == ["a b", "", "c"]
    assert one(spark, X.is_blank(F.col("s")), s=" \t\n") is True


def test_ngrams(spark):
    assert one(spark, X.ngrams(F.col("s"), 2), s=["a", "b", "c"]) == ["a b", "b c"]
    assert one(spark, X.ngrams(F.col("s"), 4), s=["a", "b", "c"]) == []
    assert one(spark, X.ngrams(F.col("s"), 1), s=["a"]) == ["a"]


def test_acronyms(spark):
    assert one(spark, X.acronym(F.col("s")), s=["artificial", "intelligence"]) == "AI"
    assert one(spark, X.acronym(F.col("s")), s=["natural", "language", "processing"]) == "NLP"
    assert one(spark, X.acronym(F.col("s")), s=["the", "art", "of", "3", "war"]) == "AW"


def test_file_names(spark):
    p = one(spark, X.path_parts(F.col("s")), s="corenlp/autchklist2.guidenote.autchkid.12668")
    assert (p.table_name, p.column_name, p.index_col, p.row_id) == ("autchklist2", "guidenote", "autchkid", "12668")
    q = one(spark, X.feed_path_parts(F.col("s")), s="a/b/NYT.10.HASH.maintext.corenlp")
    assert (q.table_name, q.row_id, q.hash, q.column_name) == ("NYT", 10, "HASH", "maintext")


def test_identifiers(spark):
    assert X.string_uid("the") == 8256174278799413254
    assert one(spark, X.word_uid(F.col("s")), s="the") == 8256174278799413254
    assert X.string_uid(None) is None and all(X.string_uid(str(i)) >= 0 for i in range(100))


def test_letter_and_alnum_words(spark):
    assert one(spark, X.letter_words(F.col("s")), s="The 3 Cats sat, down") == ["the", "cats", "down"]
    assert one(spark, X.alnum_words(F.col("s")), s="a-b_c 1.5") == ["a", "b", "c", "1", "5"]
    assert one(spark, X.bag_key(F.col("s")), s=["b", "a"]) == one(spark, X.bag_key(F.col("s")), s=["a", "b"])


def test_vectors_against_numpy(spark):
    a, b = [1.0, -2.0, 3.5], [0.5, 4.0, -1.0]
    x, y = np.array(a), np.array(b)
    A, B = F.col("a"), F.col("b")
    want = [
        (V.dot(A, B), x @ y),
        (V.l1_norm(A), np.abs(x).sum()),
        (V.l2_norm(A), np.linalg.norm(x)),
        (V.cosine(A, B), x @ y / np.linalg.norm(x) / np.linalg.norm(y)),
        (V.squared_distance(A, B), ((x - y) ** 2).sum()),
        (V.vector_sum(V.analogy(A, B, A)), (x + y - x).sum()),
        (V.vector_sum(V.normalise(A)), (x / np.linalg.norm(x)).sum()),
        (V.sigmoid(F.lit(0.3)), 1 / (1 + math.exp(-0.3))),
        (V.mirrored_sigmoid(F.lit(0.3)), 1 / (1 + math.exp(0.3))),
    ]
    for column, value in want:
        assert one(spark, column, a=a, b=b) == pytest.approx(value)
    assert one(spark, V.cosine(A, B), a=[0.0], b=[1.0]) is None
    assert one(spark, V.pair_features(A, B), a=a, b=b) == pytest.approx([*(x + y), *abs(x - y)])
    assert one(spark, V.pair_features_last(A, B), a=a, b=b) == pytest.approx([*(x + y), abs(x - y)[-1]])


def test_trees():
    t = trees.parse_tree("(a (b c))")
    assert t == ("a", ("b", "c")) and trees.show(t) == "(a (b c))" and trees.height(t) == 2
    words = "a name of the cat on a hat".split()
    built = trees.merge_by_history(words, [0, 5, 3, 1, 2, 0, 0])
    assert trees.leaves(built) == words
    assert trees.span_difference(t, t) == 0 and trees.agreement(t, t) == 1.0
    assert trees.span_difference(t, trees.parse_tree("((a b) c)")) == 1
    assert trees.spans(t) == [(1, 2), (0, 2)] and trees.span_keys(t) == [5, 2]
    assert trees.binarise(trees.read_treebank("(S (NP (DT the) (NN cat)) (-NONE- *) (VP (VB sat)))")) == (("the", "cat"), "sat")
    for bad in ("(a b", "a)", ""):
        with pytest.raises(ValueError, match="bracket"):
            trees.parse_tree(bad)


def test_chart_is_never_below_greedy():
    rng = np.random.default_rng(0)
    for seed in range(8):
        m = parser.Merger.random(5, seed)
        words = [f"w{i}" for i in range(6)]
        vs = list(rng.normal(size=(6, 5)))
        tree, low = parser.greedy(m, words, vs)
        assert trees.leaves(tree) == words
        best, high = parser.chart(m, words, vs)
        assert high >= low - 1e-12 and trees.leaves(best) == words


def test_greedy_parse_in_context():
    m = parser.ContextMerger.random(4, 1)
    vs = list(np.random.default_rng(2).normal(size=(5, 4)))
    words = list("abcde")
    tree, score = parser.greedy_in_context(m, words, vs)
    assert trees.leaves(tree) == words and math.isfinite(score)
    m.v[:] = 0
    assert parser.greedy_in_context(m, words, vs)[0] == parser.greedy(m, words, vs)[0]
    assert parser.greedy_in_context(m, ["a"], vs[:1]) == ("a", 0.0)


def test_gradient_against_differences_and_optimizers_climb():
    m = parser.Merger.random(3, 1)
    vs = {w: np.random.default_rng(i).normal(size=3) for i, w in enumerate("abc")}
    tree = ("a", ("b", "c"))
    s, g = parser.score_gradient(m, tree, vs.__getitem__)
    for name in ("w", "b", "u"):
        x = getattr(m, name)
        i = np.unravel_index(1, x.shape)
        x[i] += 1e-6
        up = parser.score_gradient(m, tree, vs.__getitem__)[0]
        x[i] -= 1e-6
        assert (up - s) / 1e-6 == pytest.approx(g[name][i], abs=1e-4)
    for opt in (parser.AdaGrad(), parser.RmsProp(), parser.DecayingSgd()):
        n = parser.Merger.random(3, 2)
        before = parser.score_gradient(n, tree, vs.__getitem__)[0]
        for _ in range(15):
            opt.step({"w": n.w, "b": n.b, "u": n.u}, parser.score_gradient(n, tree, vs.__getitem__)[1])
        assert parser.score_gradient(n, tree, vs.__getitem__)[0] > before


def test_minibatch_gradient_equals_the_sum(spark):
    m = parser.Merger.random(3, 1)
    vs = {w: np.random.default_rng(i).normal(size=3) for i, w in enumerate("abc")}
    texts = ["(a b)", "(a (b c))", "((c b) a)"] * 4
    total, grads = parser.minibatch_gradient(spark.createDataFrame([(t,) for t in texts], "tree string").repartition(3), vs, m)
    want = [parser.score_gradient(m, trees.parse_tree(t), vs.__getitem__) for t in texts]
    assert total == pytest.approx(sum(s for s, _ in want))
    assert np.allclose(grads["w"], sum(g["w"] for _, g in want))


def test_symbolic(spark):
    x, y = symbolic.Var("x"), symbolic.Var("y")
    e = symbolic.call("tanh", x * y + 2 * x) + symbolic.call("sigmoid", y) * 3
    env = {"x": 0.3, "y": -0.7}
    for v in "xy":
        up = symbolic.evaluate(e, env | {v: env[v] + 1e-6})
        assert (up - symbolic.evaluate(e, env)) / 1e-6 == pytest.approx(symbolic.evaluate(symbolic.diff(e, v), env), abs=1e-4)
    assert symbolic.diff(x * 0 + 1, "x") == symbolic.Const(0.0) and x + 0 == x and 1 * x == x
    df = spark.createDataFrame([(0.3, -0.7)], "x double, y double")
    assert df.selectExpr(symbolic.source(e) + " AS v").first().v == pytest.approx(symbolic.evaluate(e, env))


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.sampled_from("abcd"), lambda t: st.tuples(t, t), max_leaves=12))
def test_trees_round_trip(t):
    assert trees.parse_tree(trees.show(t)) == t
    assert len(trees.spans(t)) == len(trees.leaves(t)) - 1
