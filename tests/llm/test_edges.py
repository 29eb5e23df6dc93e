"""Empty tables, nulls in every column, repeated rows, hot keys and clashing names, for every operator."""

from pyspark.sql import functions as F

from textloom.llm import distinct, encoding, frequency, mixing, packing, quality, sentences, topn


def test_empty_tables(spark, tmp_path):
    r = spark.createDataFrame([], "src_field string, rec_key long, rec_id long, text string")
    assert distinct.distinctive_terms(r).count() == 0
    assert sentences.sentences(r, with_text=True).count() == 0
    assert encoding.restored(spark.createDataFrame([], "row_uid long, lang string, text string")).count() == 0
    s = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("m", "a", 0.5, 2)], "mix_name string, source string, target_share double, max_repeats int")
    assert mixing.mix(s, t).count() == 0
    assert [(x.source, x.tokens, x.actual_share) for x in mixing.shares(s, t).collect()] == [("a", 0, 0.0)]
    assert mixing.mix(s, t.limit(0)).count() == 0 == mixing.shares(s, t.limit(0)).count()
    store = frequency.TermCounts(spark, str(tmp_path / "s"))
    empty = spark.createDataFrame([], "field string, terms array<string>, sign int")
    assert store.apply(empty).marked().count() == 0 and store.apply(empty).counts().count() == 0
    caps = spark.createDataFrame([("a", 10)], "container_kind string, capacity_tokens long")
    assert packing.filled(packing.pack(s, {"a": 10}, "doc_id", "n_tokens"), caps).count() == 0


def test_nulls_in_every_column(spark):
    r = spark.createDataFrame([(None, None, None, None), ("f", None, None, "a b"), ("f", 1, 1, None), (None, 2, 2, "A one. B two.")], "src_field string, rec_key long, rec_id long, text string")
    assert distinct.distinctive_terms(r, min_df=1).count() >= 0
    assert sentences.sentences(r).count() == 3
    e = spark.createDataFrame([(None, None, None), (None, "de", "FÃ¼r"), (1, None, "ok")], "row_uid long, lang string, text string")
    assert [x.row_uid for x in encoding.restored(e).collect()] in ([None], [])
    q = spark.createDataFrame([(None, "text"), (1, None)], "doc_id long, text string")
    assert quality.quality(q).count() == 0
    s = spark.createDataFrame([(None, None, None), (1, None, 5), (None, "a", 5), (2, "a", None)], "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([(None, "a", 0.5, 2), ("m", None, 0.5, 2), ("m", "a", None, 2), ("n", "a", 1.0, None)], "mix_name string, source string, target_share double, max_repeats int")
    assert {x.mix_name for x in mixing.mix(s, t).collect()} <= {"n"}
    assert packing.pack(s, {"a": 10}, "doc_id", "n_tokens").count() == 1


def test_hot_groups_and_repeated_rows(spark, tmp_path):
    rows = [("f", k if k % 3 else 0, "same words here" if k % 3 == 0 else f"w{chr(97 + k % 20)} same") for k in range(900)]
    r = spark.createDataFrame(rows, "src_field string, rec_key long, text string")
    got = distinct.distinctive_terms(r)
    assert got.filter("rec_key = 0").count() == 3 and got.groupBy("rec_key").count().filter("count > 3").count() == 0
    change = r.select(F.col("src_field").alias("field"), frequency.white_space_terms(F.col("text")).alias("terms"), F.lit(1).alias("sign"))
    counts = {x.term: (x.occurrences, x.records) for x in frequency.TermCounts(spark, str(tmp_path / "s")).apply(change).counts().collect()}
    assert counts["same"] == (900, 900) and counts["here"] == (300, 300)
    s = spark.createDataFrame([(k, "hot" if k % 3 == 0 else f"s{k % 7}", 7) for k in range(2000)], "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("m", "hot", 0.9, 5), ("m", "s1", 0.1, 1)], "mix_name string, source string, target_share double, max_repeats int")
    got = {x.source: x.actual_share for x in mixing.shares(s, t).collect()}
    assert abs(got["hot"] - 0.9) < 0.02
    ties = spark.createDataFrame([(1, k % 50, 1.0) for k in range(5000)], "g long, i long, s double")
    assert sorted(x.i for x in topn.top_n_per_group(ties, "g", "i", "s", n=5, row_group_bytes=4096).collect()) == [0, 1, 2, 3, 4]


def test_clashing_names(spark):
    names = ["tf", "df", "cf", "n", "share", "observed", "over", "rank", "term", "t", "x"]
    r = spark.createDataFrame([("f", k, "alpha beta" if k < 5 else "beta gamma") for k in range(9)], "src_field string, rec_key long, text string")
    assert distinct.distinctive_terms(r.withColumns({c: F.lit(1) for c in names})).count() == distinct.distinctive_terms(r).count()
    d = spark.createDataFrame([(1, "One here. Two there.")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "idx", "first", "last", "words", "n")})
    assert quality.quality(d).first().prose_share == 1.0
    s = spark.createDataFrame([(1, "a", 5)], "doc_id long, source string, n_tokens long").withColumns({c: F.lit(1) for c in ("h", "bucket", "upto", "inner", "base", "shard", "k", "mix_name", "taken")})
    t = spark.createDataFrame([("m", "a", 1.0, 2)], "mix_name string, source string, target_share double, max_repeats int").withColumns({c: F.lit(1) for c in ("available", "place", "slope", "u")})
    assert mixing.mix(s, t).count() == 1 and packing.pack(s, {"a": 9}, "doc_id", "n_tokens").count() == 1
