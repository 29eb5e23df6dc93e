"""Results of a search as rows and JSON: clips, score lists, texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X

def clip(matches: list[tuple[float, int, int]], begs: list[int], ends: list[int], max_len: int) -> tuple[int, int]:
    """(begin, end) characters of the clip of a sentence.

    It starts at the best match and takes in further matches, best first, while it stays shorter than max_len; then it
    grows word by word on both sides until the next word would pass max_len.
    """
    n = len(begs)
    if n == 0:
        return 0, 0
    if matches:
        ranked = sorted(matches, key=lambda m: (-m[0], m[1]))
        b, e = ranked[0][1], ranked[0][2]
        for _, mb, me in ranked[1:]:
            nb, ne = min(b, mb), max(e, me)
            if ne - nb < max_len:
                b, e = nb, ne
    else:
        b, e = begs[0], ends[0]
    left = max((i for i in range(n) if begs[i] < b), default=-1)
    right = min((i for i in range(n) if ends[i] > e), default=n)
    grew = True
    while grew:
        grew = False
        if left >= 0 and e - begs[left] <= max_len:
            b, left, grew = begs[left], left - 1, True
        if right < n and ends[right] - b <= max_len:
            e, right, grew = ends[right], right + 1, True
    return b, e


def clip_offsets(matches: Column, begs: Column, ends: Column, max_len: int = 200) -> Column:
    """Clip of the few ranked results of a query; it folds over one sentence and runs on ranked rows alone."""

    @F.pandas_udf("struct<beg:int,end:int>")
    def fold(ms: pd.Series, bs: pd.Series, es: pd.Series) -> pd.DataFrame:
        rows = []
        for m, b, e in zip(ms, bs, es, strict=True):
            found = [] if m is None else [(x["score"], x["beg"], x["end"]) for x in m]
            rows.append((None, None) if b is None else clip(found, list(b), list(e), max_len))
        return pd.DataFrame(rows, columns=["beg", "end"]).astype("Int32")

    return fold(matches, begs, ends)


def score_list(matches: DataFrame, keys: list[str]) -> DataFrame:
    """scores_with_offset: matches with a score, best first, per result (keys); columns score, q_beg, q_end, beg, end."""
    m = F.struct((-F.col("score")).alias("neg"), "beg", "end", "q_beg", "q_end")
    rows = matches.filter(F.col("score") != 0).groupBy(*keys).agg(F.array_sort(F.collect_list(m)).alias("ms"))
    return rows.select(*keys, F.transform("ms", lambda x: F.struct((-x.neg).alias("score"), x.q_beg.alias("q_beg"), x.q_end.alias("q_end"), x.beg.alias("beg"), x.end.alias("end"))).alias("scores_with_offset"))


def is_highly_met(results: DataFrame, query_words: DataFrame) -> DataFrame:
    """Whether a result's score exceeds the sum of its query's word importances (q, score)."""
    total = query_words.groupBy("q").agg(F.sum("score").alias("total"))
    return results.join(total, "q", "left").withColumn("is_highly_met", F.col("score") > F.coalesce("total", F.lit(0.0))).drop("total")


def with_text(results: DataFrame, texts: DataFrame, key: str, text: str, beg: str, end: str) -> DataFrame:
    """Adds the sentence by code points and the whole row text."""
    rows = results.join(texts.select(key, F.col(text).alias("row_text")), key, "left")
    return rows.withColumn("sentence_text", X.code_points(F.col("row_text"), F.col(beg), F.col(end)))


def as_json(results: DataFrame, query: str, order: str, fields: list[str]) -> DataFrame:
    """(query, result_json): per query one document of parallel arrays, one per field, in rank order."""
    ranked = F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    rows = results.groupBy(query).agg(ranked.alias("rs"))
    return rows.select(query, F.to_json(F.struct(*[F.col(f"rs.{f}").alias(f) for f in fields])).alias("result_json"))


def did_you_mean(words: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """(key, original, corrected, changes): words of no importance take the last dictionary spelling that equals them but for
    capitals.  words: key, pos, word, score; dictionary: word, ord (place in its file)."""
    forms = dictionary.groupBy(F.lower("word").alias("low")).agg(F.max_by("word", "ord").alias("form"))
    rows = words.withColumn("low", F.lower("word")).join(forms, "low", "left")
    better = F.when((F.coalesce("score", F.lit(0.0)) == 0) & F.col("form").isNotNull(), F.col("form")).otherwise(F.col("word"))
    rows = rows.withColumn("better", better)
    per = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "word", "better"))).alias("ws"))
    return per.select(
        key,
        F.array_join(F.transform("ws", lambda w: w.word), " ").alias("original"),
        F.array_join(F.transform("ws", lambda w: w.better), " ").alias("corrected"),
        F.transform(F.filter("ws", lambda w: w.word != w.better), lambda w: F.concat_ws(">", w.word, w.better)).alias("changes"),
    )
