"""Exact nearest neighbours by vantage-point trees: one tree per batch of rows, merged per query."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class MetricTree:
    """A vantage-point tree over the rows of a matrix under the Euclidean distance; nodes are arrays, not objects."""

    def __init__(self, x: np.ndarray, leaf: int = 16, seed: int = 1):
        self.x, self.leaf = np.asarray(x, float), leaf
        rng = np.random.default_rng(seed)
        #: of a node: (vantage point, radius, inside, outside), or the rows of a leaf
        self.nodes: list[tuple | np.ndarray] = []
        waiting = [(np.arange(len(self.x)), -1, 0)]
        while waiting:
            rows, parent, side = waiting.pop()
            at = len(self.nodes)
            if parent >= 0:
                p = list(self.nodes[parent])
                p[2 + side] = at
                self.nodes[parent] = tuple(p)
            if len(rows) <= leaf:
                self.nodes.append(rows)
                continue
            point = int(rng.choice(rows))
            d = np.linalg.norm(self.x[rows] - self.x[point], axis=1)
            radius = float(np.median(d))
            inside = d <= radius
            if inside.all():  # the rows are as far from the point as each other
                self.nodes.append(rows)
                continue
            self.nodes.append((point, radius, -1, -1))
            waiting += [(rows[inside], at, 0), (rows[~inside], at, 1)]

    def search(self, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k nearest rows as (distance, row), nearest first; equal distances go to the smaller row."""
        best: list[tuple[float, int]] = []  # a heap of the negative distances and rows
        stack: list[tuple[int, float]] = [(0, 0.0)] if self.nodes else []

        def offer(rows: np.ndarray) -> None:
            for d, r in zip(np.linalg.norm(self.x[rows] - q, axis=1).tolist(), rows.tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (-d, -r))
                elif (-d, -r) > best[0]:
                    heapq.heapreplace(best, (-d, -r))

        while stack:
            at, least = stack.pop()
            if len(best) == k and least > -best[0][0]:
                continue  # no row below can be near enough
            node = self.nodes[at]
            if isinstance(node, np.ndarray):
                offer(node)
                continue
            point, radius, inside, outside = node
            d = float(np.linalg.norm(self.x[point] - q))
            near, far = ((inside, max(0.0, d - radius)), (outside, max(0.0, radius - d)))
            stack += [far, near] if d <= radius else [near, far]
        return sorted((-d, -r) for d, r in best)


def nearest_by_tree(stated: DataFrame, every: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, id, distance, rank): the k nearest other rows of each stated vector.  The stated set is a bounded one."""
    asked = [(r[0], np.asarray(r[1], float)) for r in stated.select(key, vector).filter(f"`{vector}` is not null").collect()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            pdf = pdf.sort_values("id")
            own, tree = pdf["id"].to_numpy(), MetricTree(np.stack(pdf["v"].to_numpy()))
            rows = [(q, own[r], d) for q, v in asked for d, r in tree.search(v, k + 1)]
            yield pd.DataFrame(rows, columns=["query", "id", "distance"])

    found = every.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter("v is not null").mapInPandas(run, "query long, id long, distance double")
    w = Window.partitionBy("query").orderBy(F.round("distance", 9), "id")
    return found.filter("query <> id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
