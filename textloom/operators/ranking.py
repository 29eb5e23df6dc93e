"""Rank cuts, per-group limits and de-duplication, all by windows that Spark limits map-side where it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, n: int, score: str, tie: str) -> DataFrame:
    """The n best rows; fewer rows are all kept."""
    return df.orderBy(F.col(score).desc(), F.col(tie).asc()).limit(n)


def max_per_key(df: DataFrame, keys: list[str], score: str, carry: list[str]) -> DataFrame:
    """One row per key: the one of highest score; ties go to the smallest carried values."""
    best = F.min(F.struct((-F.col(score)).alias("neg"), *carry)).alias("_tx_b")
    return df.groupBy(*keys).agg(best).select(*keys, (-F.col("_tx_b.neg")).alias(score), *[F.col(f"_tx_b.{c}").alias(c) for c in carry])


def half_cut(df: DataFrame, query: str, n: int, score: str, tie: str) -> DataFrame:
    """Per query the n best rows whose score is strictly above half of the best.

    The n best come first, from a window that keeps n rows per task, so the best score is looked up among n rows.
    """
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(tie).asc())
    kept = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    best = F.max(score).over(Window.partitionBy(query))
    return kept.withColumn("_tx_best", best).filter(F.col(score) > 0.5 * F.col("_tx_best")).drop("_tx_best")


def unique_chunk_cut(df: DataFrame, query: str, chunk: str, n: int, score: str) -> DataFrame:
    """Per query, rows in order of score until the n-th distinct chunk appears, with at least half of the best score.

    The n best chunks of a query, found from one row per chunk by a window that keeps n rows per task, give the place where
    its list ends; rows are then only compared with that place.  Rows that equal the last one in score and chunk are in.
    """
    per = df.groupBy(query, chunk).agg(F.max(score).alias("_tx_s"))
    w = Window.partitionBy(query).orderBy(F.col("_tx_s").desc(), F.col(chunk).asc())
    top = per.withColumn("_tx_k", F.row_number().over(w)).filter(F.col("_tx_k") <= n)
    last = F.max_by(F.struct(F.col("_tx_s").alias("s"), F.col(chunk).alias("c")), "_tx_k")
    ends = top.groupBy(query).agg(F.max("_tx_s").alias("_tx_best"), F.count("*").alias("_tx_chunks"), last.alias("_tx_last"))
    rows = df.join(ends, query)
    before = (F.col(score) > F.col("_tx_last.s")) | ((F.col(score) == F.col("_tx_last.s")) & (F.col(chunk) <= F.col("_tx_last.c")))
    kept = rows.filter((F.col(score) >= 0.5 * F.col("_tx_best")) & (before | (F.col("_tx_chunks") < n)))
    return kept.drop("_tx_best", "_tx_chunks", "_tx_last")


def top_per_table(df: DataFrame, table: str, n: int, score: str, tie: str) -> DataFrame:
    w = Window.partitionBy(table).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def row_cut(df: DataFrame, table: str, column: str, row: str, n: int, score: str) -> DataFrame:
    """(table, row, row_score): best score per column, summed per row, rows above half of their table's best, n per table."""
    best = df.groupBy(table, column, row).agg(F.max(score).alias("s"))
    per_row = best.groupBy(table, row).agg(F.sum("s").alias("row_score"))
    w = Window.partitionBy(table).orderBy(F.col("row_score").desc(), F.col(row).asc())
    ranked = per_row.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)  # n rows a task and table
    ranked = ranked.withColumn("_tx_top", F.max("row_score").over(Window.partitionBy(table)))
    return ranked.filter(F.col("row_score") > 0.5 * F.col("_tx_top")).drop("_tx_top")


def bag_dedup(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """One row per bag key: the best ranked."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn("_tx_n", F.row_number().over(w)).filter("_tx_n = 1").drop("_tx_n")


def cumulative(df: DataFrame, weight: str, order: str, part: str) -> DataFrame:
    """lo, hi: the cell of each row in the cumulative weights of its part, for inverse lookup by a range join."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hi = F.sum(weight).over(w)
    return df.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col(weight))


def newest(df: DataFrame, key: str, *versions: str) -> DataFrame:
    """The row of the highest version of every key."""
    w = Window.partitionBy(key).orderBy(*[F.col(v).desc() for v in versions])
    return df.withColumn("_tx_n", F.row_number().over(w)).filter("_tx_n = 1").drop("_tx_n")
