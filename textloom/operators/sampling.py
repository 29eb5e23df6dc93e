"""Seeded samples, weighted draws and shuffled pairs, repeatable whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import workspace


def _uniform(key: str, seed: int) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def random_rows(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows in random order of a seed; each task keeps n rows at most."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def subsample(df: DataFrame, key: str, keep: str, seed: int = 1) -> DataFrame:
    """Keeps each row with its own probability."""
    return df.filter(_uniform(key, seed) < F.col(keep))


def cumulative_cells(df: DataFrame, key: str, weight: str, buckets: int = 4096) -> DataFrame:
    """(key, w, lo, hi): the cell of every key in the cumulative weights, in hash order.

    Prefix sums in two levels: over hash buckets, of which there are few, then within each, so no task holds all keys.
    """
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(buckets))
    rows = df.select(key, F.col(weight).cast("double").alias("w"), bucket.alias("_tx_b")).filter("w > 0")
    before = Window.orderBy("_tx_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("_tx_b").agg(F.sum("w").alias("s")).select("_tx_b", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("_tx_base"))
    inside = Window.partitionBy("_tx_b").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = rows.withColumn("_tx_inner", F.sum("w").over(inside)).join(F.broadcast(bases), "_tx_b")  # at most a row per bucket
    hi = F.col("_tx_base") + F.col("_tx_inner")
    return cells.select(key, "w", (hi - F.col("w")).alias("lo"), hi.alias("hi"))


def weighted_draws(df: DataFrame, key: str, weight: str, draws: DataFrame, draw: str, seed: int = 1) -> DataFrame:
    """(draw, key): for every draw one key with probability weight / total, by looking up a random number in the cumulative
    weights.  The lookup meets in as many cells of equal weight as there are keys, so a draw meets two keys on average,
    and it is an equi-join and not a comparison of all pairs."""
    cells = workspace.materialise(cumulative_cells(df, key, weight), "cells")
    total, n = cells.agg(F.coalesce(F.max("hi"), F.lit(0.0)), F.count("*")).first()
    if not n:
        return draws.select(draw, F.lit(None).cast(dict(df.dtypes)[key]).alias(key)).limit(0)
    width = max(1, n)
    lo, hi = F.floor(F.col("lo") / total * width), F.floor(F.col("hi") / total * width)
    cells = cells.withColumn("_tx_cell", F.explode(F.sequence(lo, F.least(hi, F.lit(width - 1)))))
    thrown = draws.select(draw, _uniform(draw, seed).alias("_tx_r")).withColumn("_tx_cell", F.floor(F.col("_tx_r") * width))
    x = F.col("_tx_r") * total
    return thrown.join(cells, "_tx_cell").filter((x >= F.col("lo")) & (x < F.col("hi"))).select(draw, key)


def shuffled_pairs(df: DataFrame, key: str, left: str, right: str, buckets: int | None = None, seed: int = 1) -> DataFrame:
    """(key, left, right): right sides from other rows, as negative examples.  Rows trade places within random buckets, of
    about 10,000 rows each unless their number is given."""
    buckets = buckets or max(1, df.count() // 10_000)
    order = F.xxhash64(F.col(key), F.lit(seed))
    rows = df.select(key, left, right, F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(buckets)).alias("_tx_b"), order.alias("_tx_o"))
    w = Window.partitionBy("_tx_b").orderBy("_tx_o", key)
    first = F.first(right).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("_tx_other", F.coalesce(F.lead(right).over(w), first)).select(key, left, F.col("_tx_other").alias(right))
