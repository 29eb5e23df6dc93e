"""Filling fixed-capacity windows with documents by sum-of-squares online packing.

The open windows of a shard are held in a level array: N(h) windows are filled to level h.  A document of size s goes to
the level h (0: a new window) for which moving one window from h to h + s leaves the smallest sum of N(h)^2 over the
partially filled levels; equal choices prefer the fuller window.  So no level piles up, and windows find a partner that
fills them.

Documents are hashed to shards of about ``shard_items`` documents, each packed on its own in hash order, so the work
scales out, no task holds more than a shard, and the result depends on the documents alone.  A shard's loss is its
partially filled windows, which the method keeps few.

Defined cases: a document longer than the capacity is split into full windows and a rest, which is packed like a
document; nothing else is split; null texts and texts of no token need no room and give no rows; repeated texts are
packed each; repeated keys too; a capacity that is null or below 1 gives no windows; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BIG = 1 << 40


class Packer:
    """Sum-of-squares packing of a stream of sizes into windows of one capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.twice = np.zeros(capacity + 1, dtype=np.int64)  # 2 N(h); a full window counts nothing
        self.twice[capacity] = -1
        self.leave = np.full(capacity + 1, _BIG, dtype=np.int64)  # change for taking a window from level h
        self.open: list[list[int]] = [[] for _ in range(capacity)]
        self.windows = 0

    def _new(self) -> int:
        self.windows += 1
        return self.windows - 1

    def place(self, size: int) -> list[tuple[int, int, int]]:
        """(window, begin, size) of each piece of an item; begin is the level at which it starts."""
        out = []
        while size > self.capacity:
            out.append((self._new(), 0, self.capacity))
            size -= self.capacity
        if size == self.capacity:
            return [*out, (self._new(), 0, size)]
        if size <= 0:
            return out
        c = self.capacity
        change = self.leave[1 : c - size + 1] + self.twice[1 + size : c + 1]
        level, least = 0, int(self.twice[size]) + 1
        if len(change):
            k = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= least:
                level = k + 1
        window = self.open[level].pop() if level else self._new()
        if level:
            self._count(level, -2)
        if level + size < c:
            self.open[level + size].append(window)
            self._count(level + size, 2)
        return [*out, (window, level, size)]

    def _count(self, level: int, by: int) -> None:
        self.twice[level] += by
        n2 = int(self.twice[level])
        self.leave[level] = 2 - n2 if n2 else _BIG


def pack(sizes: DataFrame, capacities: dict[str, int], key: str, size: str, shard_items: int = 25_000) -> DataFrame:
    """(container_kind, container_id, key, piece, begin, n_tokens): where every document went, for every kind.

    ``capacities`` comes from a fixed small table.  container_id is unique within its kind.
    """
    items = sizes.filter(F.col(key).isNotNull() & (F.col(size) > 0))
    shards = max(1, math.ceil(items.count() / shard_items))
    kinds = {k: int(c) for k, c in sorted(capacities.items()) if c is not None and c > 0}
    key_type = dict(sizes.dtypes)[key]
    schema = f"container_kind string, container_id long, {key} {key_type}, piece int, begin long, n_tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, packers = None, {}
        for pdf in batches:
            out: dict[str, list] = {c: [] for c in ("container_kind", "container_id", key, "piece", "begin", "n_tokens")}
            for s, k, n in zip(pdf["shard"].tolist(), pdf["k"], pdf["n"].tolist(), strict=True):
                if s != shard:
                    shard, packers = s, {kind: Packer(c) for kind, c in kinds.items()}
                for kind, packer in packers.items():
                    for piece, (window, begin, part) in enumerate(packer.place(n)):
                        for column, x in zip(out.values(), (kind, (s << 32) + window, k, piece, begin, part), strict=True):
                            column.append(x)
            yield pd.DataFrame(out)

    h = F.xxhash64(F.col(key), F.lit(1))
    spread = items.select(F.pmod(h, F.lit(shards)).alias("shard"), h.alias("h"), F.col(key).alias("k"), F.col(size).cast("long").alias("n"))
    return spread.repartition(shards, "shard").sortWithinPartitions("shard", "h", "k", "n").mapInPandas(run, schema)


def filled(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per kind: windows, tokens and the share of the room that is filled.  capacities is a small fixed table."""
    # windows of a kind differ by id: count each once by the piece at its beginning
    per = packed.groupBy("container_kind").agg(
        F.sum(F.when(F.col("begin") == 0, 1).otherwise(0)).alias("containers"),
        F.sum("n_tokens").alias("tokens"),
    )
    share = F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6)
    return per.join(F.broadcast(capacities), "container_kind").select("container_kind", "containers", "tokens", share.alias("filled_share"))
