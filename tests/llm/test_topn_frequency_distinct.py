import math
import os
import random
import re
from collections import Counter

from textloom.llm import distinct, frequency, topn


def brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if g is None or i is None or s is None or not math.isfinite(s) or s <= 0:
            continue
        best[g, i] = max(s, best.get((g, i), 0))
    out = set()
    for g in {g for g, _ in best}:
        ranked = sorted(((-s, i) for (h, i), s in best.items() if h == g))
        out |= {(g, i) for _, i in ranked[:n]}
    return out


def test_top_n_against_brute_force_with_hot_group_ties_and_dirt(spark):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.4 else rng.randrange(2, 60), rng.randrange(400), rng.choice([0.5, 1.0, 1.5, 2.0, rng.random() * 3])) for _ in range(6000)]
    rows += [(None, 1, 9.0), (1, None, 9.0), (1, 2, None), (1, 3, float("nan")), (1, 4, float("inf")), (2, 5, 0.0), (2, 6, -1.0)]
    df = spark.createDataFrame([(g, i, s, "x") for g, i, s in rows], "g long, i long, s double, grp string")
    got = topn.top_n_per_group(df, "g", "i", "s", n=5, row_group_bytes=2000)
    assert {(r.g, r.i) for r in got.collect()} == brute_top(rows, 5)
    assert got.count() == got.select("g", "i").distinct().count()


def test_row_groups_below_the_current_nth_score_are_skipped(spark, tmp_path):
    df = spark.range(60_000).selectExpr("1L as grp", "id as item", "cast(id % 1000 as double) + 1 as score")
    topn.cluster_by_group(df, str(tmp_path / "t"), 8192)
    index = topn.row_group_index(spark, str(tmp_path / "t"))
    assert index.count() > 4
    tops = [r.top for r in index.collect()]
    assert max(tops) == 1000 and min(tops) < 900  # later row groups can be skipped
    got = topn.top_n_per_group(df, "grp", "item", "score", n=3, row_group_bytes=8192)
    assert sorted((r.item, r.rank) for r in got.collect()) == [(999, 1), (1999, 2), (2999, 3)]


def test_a_group_of_a_million_is_read_in_part_and_tables_are_removed(spark, tmp_path):
    """Of the large group only its first row groups are read; small groups, whose first rows all row groups hold, are read whole."""
    hot = spark.range(1_000_000).selectExpr("7L as g", "id as i", "cast((id * 7919) % 1000003 as double) + 1 as s")
    small = spark.range(3_000).selectExpr("id div 6 + 100 as g", "id as i", "cast(id % 11 as double) + 1 as s")
    rows = topn.Clustered.build(hot.unionByName(small), "g", "i", "s")
    best = rows.top(5)
    got = {(r.grp, r.item) for r in best.collect()}
    large = sorted(((i * 7919) % 1000003, -i) for i in range(1_000_000))[-5:]
    assert {i for g, i in got if g == 7} == {-i for _, i in large}
    assert len(got) == 5 + 500 * 5
    (groups, n, size), (groups_read, n_read, size_read) = rows.whole, rows.read
    assert n == 1_003_000 and groups > 40
    assert groups_read < groups / 3 and n_read < n / 3 and size_read < size / 3
    again = rows.top(2)  # the clustered table answers any number of calls
    assert {(r.grp, r.item) for r in again.filter("grp = 7").collect()} == {(7, -i) for _, i in large[-2:]}
    at = rows.path.removeprefix("file:")
    assert os.path.exists(at)
    rows.remove()
    assert not os.path.exists(at) and best.count() == len(got)


def test_top_n_of_an_empty_table(spark):
    assert topn.top_n_per_group(spark.createDataFrame([], "g long, i long, s double"), "g", "i", "s").count() == 0


TEXTS = [(1, "b a  a\tc"), (2, None), (3, ""), (4, "a b"), (5, " \n "), (6, "x" * 5000 + " a"), (7, "Ä ä a")]


def brute_counts(texts):
    occ, rec = Counter(), Counter()
    for t in texts:
        ws = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t or "") if w]
        occ.update(ws)
        rec.update(set(ws))
    return {w: (occ[w], rec[w]) for w in occ}


def as_change(spark, texts, sign):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    from pyspark.sql import functions as F

    return df.select(F.lit("f").alias("field"), frequency.white_space_terms(F.col("text")).alias("terms"), F.lit(sign).alias("sign"))


def counted(store):
    return {r.term: (r.occurrences, r.records) for r in store.counts().collect()}


def test_counts_follow_added_deleted_and_changed_records(spark, tmp_path):
    store = frequency.TermCounts(spark, str(tmp_path / "s"))
    store.apply(as_change(spark, [t for _, t in TEXTS], 1))
    assert counted(store) == brute_counts([t for _, t in TEXTS])
    old = spark.createDataFrame(TEXTS, "k long, text string")
    now = [(1, "b a"), (2, "new"), (4, "a b"), (5, " \n "), (6, "x" * 5000 + " a"), (7, "Ä ä a"), (8, "z z")]
    new = spark.createDataFrame(now, "k long, text string")
    change = frequency.changes(old, new, "k", "text")
    assert change.count() == 2 + 2 + 1 + 1  # two changed, one deleted, one added
    from pyspark.sql import functions as F

    store.apply(change.select(F.lit("f").alias("field"), frequency.white_space_terms(F.col("text")).alias("terms"), "sign"))
    assert counted(store) == brute_counts([t for _, t in now])
    assert store.record_totals().first().n == len(now)
    before = counted(store)
    store.apply(as_change(spark, [], 1))
    assert counted(store) == before


def test_marks(spark, tmp_path):
    store = frequency.TermCounts(spark, str(tmp_path / "s")).apply(as_change(spark, ["a b"] * 3 + ["c"] * 2 + ["d d d"] + ["e"] * 60, 1))
    marks = {r.term: r.mark for r in store.marked(rare_below=3, common_share=0.05).collect()}
    assert marks == {"a": None, "b": None, "c": "rare", "d": None, "e": "common"}


def test_distinctive_terms_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(k, " ".join(rng.choice(vocabulary[: 3 + k % 18]).upper() if rng.random() < 0.2 else rng.choice(vocabulary[: 3 + k % 18]) for _ in range(rng.randrange(0, 30)))) for k in range(150)]
    docs += [(200, None), (201, ""), (202, "123 ..."), (203, "été ÉTÉ wa"), (204, "İx")]
    df = spark.createDataFrame([("f", k, t) for k, t in docs], "src_field string, rec_key long, text string")
    import unicodedata

    def terms(t):
        return [m.lower() for m in "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t).split()]

    kept = {k: terms(t) for k, t in docs if t is not None}
    tf = {k: Counter(v) for k, v in kept.items()}
    df_, cf = Counter(), Counter()
    for c in tf.values():
        df_.update(c.keys())
        cf.update(c)
    n = len(kept)
    for by, limit in (("tf_idf", 500_000), ("residual", 500_000), ("tf_idf", 0)):
        want = set()
        for k, c in tf.items():
            s = []
            for t, x in c.items():
                if df_[t] >= 3:
                    v = x * math.log(n / df_[t])
                    if by == "residual":
                        v = x * (math.log(n / df_[t]) + math.log(1 - math.exp(-cf[t] / n)))
                    s.append((-round(v, 6), t))
            want |= {(k, t) for _, t in sorted(s)[:3]}
        got = distinct.distinctive_terms(df, by=by, broadcast_terms=limit, hot_shares=5)
        assert {(r.rec_key, r.term) for r in got.collect()} == want, (by, limit)


def test_counts_are_reopened_in_another_session_and_take_changes(spark, tmp_path):
    path = str(tmp_path / "kept")
    store = frequency.TermCounts(spark, path, buckets=5).apply(as_change(spark, [t for _, t in TEXTS], 1))
    assert store.version == 1
    other = spark.newSession()
    again = frequency.TermCounts(other, path, buckets=99)
    assert (again.version, again.n_buckets) == (1, 5)
    assert {r.term: (r.occurrences, r.records) for r in again.counts().collect()} == brute_counts([t for _, t in TEXTS])
    new = {1: "b a a", 2: "now here", 3: "", 4: None, 6: "x", 8: "a late one", 9: None}
    old = other.createDataFrame(TEXTS, "k long, t string")
    change = frequency.changes(old, other.createDataFrame(list(new.items()), "k long, t string"), "k", "t")
    signs = {r.sign for r in change.collect()}
    assert signs == {1, -1}
    again.apply(change.select(frequency.F.lit("f").alias("field"), frequency.white_space_terms(frequency.F.col("text")).alias("terms"), "sign"))
    third = frequency.TermCounts(spark, path)
    assert third.version == 2
    assert {r.term: (r.occurrences, r.records) for r in third.counts().collect()} == brute_counts(list(new.values()))
    assert [r.n for r in third.record_totals().collect()] == [len(new)]
    third.vacuum()
    left = sorted(x for x in os.listdir(path) if not x.startswith("."))
    assert [x for x in left if x.startswith("manifest")] == ["manifest-0000000002"]
    assert {r.term: (r.occurrences, r.records) for r in frequency.TermCounts(spark, path).counts().collect()} == brute_counts(list(new.values()))


def test_a_version_is_committed_once(spark, tmp_path):
    path = str(tmp_path / "race")
    one, two = frequency.TermCounts(spark, path, 3), frequency.TermCounts(spark, path, 3)
    one.apply(as_change(spark, ["a b"], 1))
    try:
        two.apply(as_change(spark, ["c"], 1))
        raise AssertionError("a second writer must not win")
    except RuntimeError:
        pass
    assert {r.term for r in frequency.TermCounts(spark, path).counts().collect()} == {"a", "b"}


def test_rows_of_a_repeated_key_are_ranked_as_one_record(spark):
    rows = [("f", 0, "alpha alpha beta")] * 300 + [("f", 1, "alpha"), ("f", 2, "gamma beta"), ("f", 3, "beta"), ("f", None, "alpha"), ("f", None, "delta")]
    df = spark.createDataFrame(rows, "src_field string, rec_key long, text string")
    got = {(r.rec_key, r.term): (r.tf, r.df, r.cf) for r in distinct.distinctive_terms(df, min_df=1).collect()}
    assert got[0, "alpha"] == (600, 302, 602) and got[0, "beta"] == (300, 302, 302)
    assert got[None, "delta"] == (1, 1, 1) and got[2, "gamma"] == (1, 1, 1)
    tf_idf = {(r.rec_key, r.term): r.tf_idf for r in distinct.distinctive_terms(df, min_df=1, by="tf_idf").collect()}
    assert tf_idf[2, "gamma"] == round(math.log(305), 6)
