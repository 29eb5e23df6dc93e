import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.ml import weighting
from textloom.operators import knowledge, sampling
from textloom.sources import readers


def item(k, **more):
    return json.dumps({"id": f"Q{k}", "type": "item", **more}) + ","


def claim(*qs):
    return [{"mainsnak": {"property": "P31", "datavalue": {"value": {"id": q}}}} for q in qs]


LINES = [
    (1, "["),
    (2, item(1, labels={"en": {"language": "en", "value": "one"}}, claims={"P31": claim("Q5", "Q6"), "P279": []}, aliases={"en": [{"language": "en", "value": "uno"}, {"language": "en", "value": "1"}]})),
    (3, "  " + item(2, labels={"en": "two"}, claims=[], aliases={"en": {"language": "en", "value": "due"}})),
    (4, item(3, labels={"de": {"language": "de", "value": "drei"}}, claims={"P31": claim("Q7")})),
    (5, item(4, labels={"en": None})),
    (6, item(5)[:-9]),
    (7, None),
    (8, ""),
    (9, "]"),
]


@pytest.fixture()
def lines(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in LINES], "line_no long, raw_line string, v string")


def test_items_aliases_and_first_claims(lines):
    got = {r.line_no: (r.id, r.type, r.p31, r.p279, r.label) for r in knowledge.items(lines).collect()}
    assert got == {2: ("Q1", "item", "P31 Q5 Q6", "P279", "one"), 3: ("Q2", "item", "P31", "P279", "two")}
    assert sorted((r.id, r.alias) for r in knowledge.aliases(lines).collect()) == [("Q1", "1"), ("Q1", "uno"), ("Q2", "due")]
    assert sorted((r.id, r.property, r.value) for r in knowledge.first_claims(lines).collect()) == [("Q1", "P31", "Q5"), ("Q3", "P31", "Q7")]


def test_tagger_output_and_flags(spark):
    df = spark.createDataFrame([("John/PER Smith/PER WORDMARK",), ("a/b/O",)], "s string")
    got = [r.t for r in df.select(knowledge.tagged_names(F.col("s")).alias("t")).collect()]
    assert [(t.name, t.tags) for t in got] == [("John Smith", "PER_PER"), ("a/b", "O")]
    e = spark.createDataFrame([("a", "c", True), ("b", "c", False), ("d", "e", False), ("f", None, True)], "entity string, class_id string, named boolean")
    assert {r.entity: r.flag for r in knowledge.entity_flags(e, "named").collect()} == {"a": "True", "b": "True", "d": "False", "f": "Unknown"}


def test_samples_are_seeded_and_independent_of_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = {r.k for r in sampling.random_rows(df, "k", 50).collect()}
    assert a == {r.k for r in sampling.random_rows(df.repartition(7), "k", 50).collect()} and len(a) == 50
    kept = sampling.subsample(df.withColumn("p", F.when(F.col("k") < 500, 0.9).otherwise(0.1)), "k", "p").collect()
    low = sum(r.k < 500 for r in kept)
    assert 420 < low < 480 and 25 < len(kept) - low < 80


def test_draws_follow_weights(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0), ("d", 6.0)], "k string, w double")
    draws = spark.range(8000).withColumnRenamed("id", "draw")
    got = sampling.weighted_draws(w, "k", "w", draws, "draw").collect()
    n = Counter(r.k for r in got)
    assert len(got) == 8000 and set(n) == {"a", "b", "d"}
    assert n["a"] / 8000 == pytest.approx(0.1, abs=0.02) and n["d"] / 8000 == pytest.approx(0.6, abs=0.02)
    many = spark.range(3000).selectExpr("id as k", "1 + id % 5 as w")
    cells = sampling.cumulative_cells(many, "k", "w", buckets=16).orderBy("lo").collect()
    at = 0.0
    for c in cells:
        assert c.lo == pytest.approx(at) and c.hi - c.lo == pytest.approx(c.w)
        at = c.hi


def test_shuffled_pairs(spark):
    df = spark.createDataFrame([(i, f"l{i}", f"r{i}") for i in range(200)], "k int, a string, b string")
    got = sampling.shuffled_pairs(df, "k", "a", "b", buckets=4).collect()
    assert sorted(r.b for r in got) == sorted(f"r{i}" for i in range(200))
    assert all(r.b != f"r{r.k}" for r in got)


def test_similar_documents_and_pair_features(spark):
    w = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "a", 2.0), (2, "b", 2.0), (3, "a", 1.0), (3, "c", 1.0), (4, "d", 1.0)], "doc int, word string, w double")
    got = weighting.document_similarity(w, spark.createDataFrame([(1,)], "doc int"), "doc", 5).orderBy("rank").collect()
    assert [(r.doc, r.sim) for r in got] == [(2, 1.0), (3, 0.5)]
    pairs = spark.createDataFrame([(i, 1 if i % 2 else -1, ["a", "b"], ["a", "b"] if i % 2 else ["c"]) for i in range(8)], "k int, label int, words1 array<string>, words2 array<string>")
    f = weighting.paraphrase_features(pairs, "k", weighting.kld_weights(pairs), 2).collect()
    assert len(f) == 8 and all(len(r.features) == 4 for r in f)


def test_requests_files_and_catalog(spark, tmp_path):
    assert readers.valid_request({"sent_uids": [], "max_clip_len": 1, "Countries": []}) and not readers.valid_request({"sent_uids": []})
    assert readers.valid_request({"sent_uids": [], "max_clip_len": 1}, "feeds")
    df = spark.createDataFrame([("t.content.id",), ("u.title.id",)], "full_name string")
    assert [r.full_name for r in readers.confined(df, "full_name", ["content"]).collect()] == ["t.content.id"] and readers.confined(df, "full_name", []).count() == 2
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "NYT.10.ab.maintext.corenlp").write_text("hello\n")
    (tmp_path / "x" / "NYT.11.ab.maintext.corenlp").write_text("other\n")
    assert [r.value for r in readers.files_named(spark, str(tmp_path), "NYT", 10).collect()] == ["hello"]
    assert readers.files_named(spark, str(tmp_path), "NYT", 99).count() == 0
    df.createOrReplaceTempView("names_view")
    assert ("names_view", "full_name", "string") in [tuple(r) for r in readers.catalog_columns(spark).collect()]
