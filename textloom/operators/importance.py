"""How important a word is: how often it survives from a full text into its summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOISY_BELOW = 0.6


def contingency(pairs: DataFrame) -> DataFrame:
    """(word, summary, full, both, n_case) of pairs (summary_words, full_words), arrays; distinct words of each side count.

    One explode and one aggregation: a word's sides are flags of its row.
    """
    s, f = F.array_distinct("summary_words"), F.array_distinct("full_words")
    rows = pairs.select(s.alias("s"), f.alias("f"))
    each = rows.select(
        F.explode(
            F.concat(
                F.transform(F.array_except("s", "f"), lambda w: F.struct(w.alias("word"), F.lit(1).alias("a"), F.lit(0).alias("b"))),
                F.transform(F.array_except("f", "s"), lambda w: F.struct(w.alias("word"), F.lit(0).alias("a"), F.lit(1).alias("b"))),
                F.transform(F.array_intersect("s", "f"), lambda w: F.struct(w.alias("word"), F.lit(1).alias("a"), F.lit(1).alias("b"))),
            )
        ).alias("x")
    )
    counts = each.groupBy(F.col("x.word").alias("word")).agg(F.sum("x.a").alias("summary"), F.sum("x.b").alias("full"), F.sum(F.col("x.a") * F.col("x.b")).alias("both"))
    return counts.withColumn("n_case", pairs.agg(F.count("*")).scalar())


def ratio(least: int = 5) -> Column:
    """both * n_case / (summary * full); 0 for words with too few cases on a side."""
    r = F.col("both") * F.col("n_case") / (F.col("summary") * F.col("full"))
    return F.when((F.col("summary") < least) | (F.col("full") < least), F.lit(0.0)).otherwise(r)


def score(r: Column) -> Column:
    """0.9 * (1 - 1 / max(1, r + 0.001))."""
    return 0.9 * (1 - 1 / F.greatest(F.lit(1.0), r + 0.001))


def report_score(r: Column, both: Column) -> Column:
    """ln(ratio) * both^0.3; 0 for small ratios or no common case."""
    return F.when((r < 0.1) | (both == 0), F.lit(0.0)).otherwise(F.log(r) * F.pow(both.cast("double"), F.lit(0.3)))


def override(word: Column, r: Column, names: list[str]) -> Column:
    """Words of a fixed list of names get the ratio 3.1."""
    return F.when(word.isin(*names), F.lit(3.1)).otherwise(r)


def is_noisy(s: Column) -> Column:
    return F.coalesce(s, F.lit(0.0)) < NOISY_BELOW


def importance_table(pairs: DataFrame) -> DataFrame:
    """(word, ratio, score)."""
    return contingency(pairs).withColumn("ratio", ratio()).select("word", "ratio", score(F.col("ratio")).alias("score"))
