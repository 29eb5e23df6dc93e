"""Similar words and vectors: threshold tables, nearest neighbours, centroids, vectors of unknown words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stated_against_all(stated: DataFrame, every: DataFrame, key: str, vector: str, keep: str, k: int, least: float, block_rows: int = 2048, sent_rows: int = 16_384) -> DataFrame:
    """(query, id, sim): for stated query vectors, all rows of cosine >= least, or the k best of all rows.

    The stated set is cut into blocks; each task multiplies a batch of rows with one block after the other, so neither side
    is ever paired row by row.  A stated set of up to ``sent_rows`` vectors goes to the tasks with the function; of a larger
    one every part of that size, by a hash of the key, is fetched and sent in turn, and scans the rows once.
    """
    parts = max(1, -(-stated.count() // sent_rows))
    scans = [_against(stated.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i), every, key, vector, keep, k, least, block_rows) for i in range(parts)]
    found = reduce(DataFrame.unionByName, scans)
    if keep == "threshold":
        return found
    w = Window.partitionBy("query").orderBy(F.round("sim", 9).desc(), "id")
    return found.filter("query <> id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _against(stated: DataFrame, every: DataFrame, key: str, vector: str, keep: str, k: int, least: float, block_rows: int) -> DataFrame:
    rows = stated.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null").orderBy("id").collect()  # a bounded part
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    q = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    norms = np.linalg.norm(q, axis=1)
    q = q / np.where(norms > 0, norms, 1)[:, None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty or not len(ids):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            n = np.linalg.norm(x, axis=1)
            x = x / np.where(n > 0, n, 1)[:, None]
            own = pdf["id"].to_numpy()
            for b in range(0, len(ids), block_rows):
                g = q[b : b + block_rows] @ x.T
                if keep == "threshold":
                    i, j = np.nonzero(g >= least)
                else:  # the k best of a batch contain the k best of all rows of it
                    m = min(k + 1, g.shape[1])
                    j = np.argpartition(-g, m - 1, axis=1)[:, :m]
                    i = np.repeat(np.arange(len(g)), m)
                    j = j.ravel()
                yield pd.DataFrame({"query": ids[b + i], "id": own[j], "sim": g[i, j]})

    return every.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter("v is not null").mapInPandas(run, "query long, id long, sim double")


def nearest(stated: DataFrame, every: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k nearest other rows of each stated vector by cosine."""
    return stated_against_all(stated, every, key, vector, "nearest", k, 0.0)


def similar_table(stated: DataFrame, every: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """All rows (itself included) of cosine >= least to each stated vector."""
    return stated_against_all(stated, every, key, vector, "threshold", 0, least)


def importance_threshold(table: DataFrame, factor: float = 0.7) -> DataFrame:
    """Pairs whose similarity reaches factor * importance of the query word; asymmetric."""
    return table.filter(F.col("sim") >= factor * F.col("score"))


def second_largest(df: DataFrame, key: str, value: str) -> DataFrame:
    """The second largest value per key, without sorting whole groups: a window that keeps two rows."""
    w = Window.partitionBy(key).orderBy(F.col(value).desc())
    return df.withColumn("n", F.row_number().over(w)).filter("n = 2").select(key, value)


def centroids(df: DataFrame, key: str, vector: str, weight: str | None = None) -> DataFrame:
    """(key, n, centroid): weighted mean vector per key, as sums per position that combine map-side."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    each = df.select(key, w.alias("w"), F.posexplode(vector).alias("i", "x"))
    sums = each.groupBy(key, "i").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("m"), F.count("*").alias("n"))
    parts = sums.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("ps"))
    return parts.select(key, "n", F.transform("ps", lambda p: p.m).alias("centroid"))


def context_vectors(contexts: DataFrame, vectors: DataFrame, word: str = "word", context: str = "context") -> DataFrame:
    """Vectors of unknown words: mean of their contexts' known vectors, weighted by how often they meet."""
    counts = contexts.groupBy(word, context).agg(F.count("*").alias("c"))
    known = counts.join(vectors.select(F.col("word").alias(context), "vec"), context)
    return centroids(known, word, "vec", "c")


def context_scores(pairs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, n, score): sum of ln sigmoid(cosine) over a sentence's word-context pairs of known words; pairs count once each
    with their number, so vectors meet pairs of words and not their occurrences."""
    from textloom.functions import vectors as V

    counts = pairs.groupBy(key, "word", "context").agg(F.count("*").alias("n"))
    a = vectors.select("word", F.col("vec").alias("va"))
    b = vectors.select(F.col("word").alias("context"), F.col("vec").alias("vb"))
    distinct = counts.select("word", "context").distinct().join(a, "word").join(b, "context")
    scored = distinct.select("word", "context", F.log(V.sigmoid(V.cosine(F.col("va"), F.col("vb")))).alias("s"))
    return counts.join(scored, ["word", "context"]).groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("s")).alias("score"))
