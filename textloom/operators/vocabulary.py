"""Counts over words: two-phase aggregations, dictionary joins, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T


def word_counts(df: DataFrame, text: str, min_count: int = 1) -> DataFrame:
    """(word, n) of white-space words; partial counts are merged map-side."""
    return df.select(F.explode(T.words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Sum of partial (word, n) counts."""
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy("word").agg(F.sum("n").alias("n"))


def document_frequency(df: DataFrame, key: str, words: Column) -> DataFrame:
    """(word, df): documents with the word; words are made distinct within a row, so no shuffle by (key, word)."""
    return df.select(key, F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def unigram(counts: DataFrame) -> DataFrame:
    """(word, n, p): share of all occurrences; the total is a scalar subquery."""
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("word", "n", (F.col("n") / total).alias("p"))


def known_and_unseen(words: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words that a vocabulary has, and those it lacks."""
    v = vocabulary.select("word")
    return words.join(v, "word", "left_semi"), words.join(v, "word", "left_anti")


def with_default(df: DataFrame, table: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """Left join with a default for keys that the table lacks."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def subsample_keep(p: Column, rate: float) -> Column:
    """Probability that an occurrence of a word of share p is kept; 1 or more keeps all."""
    x = p / F.lit(rate)
    return (F.sqrt(x) + 1) / x


def noise_weight(n: Column) -> Column:
    """Weight of a word for drawing negatives."""
    return F.pow(n.cast("double"), F.lit(0.75))


def intersect_all(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that every group has: one aggregation instead of a chain of joins."""
    n = df.agg(F.countDistinct(group)).scalar()
    return df.groupBy(key).agg(F.countDistinct(group).alias("n")).filter(F.col("n") == n).select(key)
