"""Dependency trees of sentences: subtree sums, fragility of attachments, phrases."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _order(heads: list[int]) -> list[int]:
    """Tokens from the leaves up: every token after all tokens below it.  Tokens on a cycle, and below none, come not at all."""
    n = len(heads)
    below = [0] * n
    for h in heads:
        if 0 <= h < n:
            below[h] += 1
    order = [i for i in range(n) if not below[i]]
    for i in order:  # grows while it runs
        h = heads[i]
        if 0 <= h < n:
            below[h] -= 1
            if not below[h]:
                order.append(h)
    return order


def subtree_sums(heads: list[int], weights: list[float]) -> list[float]:
    """Sum of weights below and at each token; heads are positions, -1 for a root.  Cycles count once."""
    n = len(heads)
    total = list(weights)
    for i in _order(heads):
        h = heads[i]
        if 0 <= h < n:
            total[h] += total[i]
    return total


def _fragile(s: float, top: float, w: float) -> float:
    x = s * (top - w)
    return x / w if w else (math.nan if x == 0 else math.copysign(math.inf, x))


def fragility(heads: list[int], weights: list[float]) -> list[float]:
    """S * (S(head) - w) / w per token; S is its subtree's sum, S(head) is 0 for roots, and a weight of 0 gives an infinity or NaN."""
    s = subtree_sums(heads, weights)
    return [_fragile(s[i], s[h] if 0 <= (h := heads[i]) < len(heads) else 0.0, w) for i, w in enumerate(weights)]


def phrases(heads: list[int], weights: list[float], cutoff: float | None = None, cuts: int | None = None) -> list[list[int]]:
    """Cuts a sentence into phrases: again and again at the token of highest fragility, while it reaches the cutoff, or a
    fixed number of times.  NaN is lowest; ties go to the first token.  Phrases are sorted token positions.

    A cut lowers the sums of the tokens above it alone, so only these and the tokens right below them are measured again;
    the highest comes from a heap whose outdated entries are passed over.
    """
    heads = list(heads)
    n = len(heads)
    s = subtree_sums(heads, weights)
    below: list[list[int]] = [[] for _ in range(n)]
    for i, h in enumerate(heads):
        if 0 <= h < n:
            below[h].append(i)
    now = [0.0] * n
    heap: list[tuple[float, int]] = []

    def measure(i: int) -> None:
        now[i] = f = _fragile(s[i], s[heads[i]] if 0 <= heads[i] < n else 0.0, weights[i])
        if not math.isnan(f):
            heapq.heappush(heap, (-f, i))

    for i in range(n):
        measure(i)
    left = cuts if cuts is not None else n
    while left > 0 and heap:
        f, k = heapq.heappop(heap)
        if not 0 <= heads[k] < n or now[k] != -f:
            continue
        if cutoff is not None and -f < cutoff:
            break
        above, steps = heads[k], 0
        below[above].remove(k)
        heads[k] = -1
        left -= 1
        gone, changed = s[k], []
        while 0 <= above < n and steps <= n:
            s[above] -= gone
            changed.append(above)
            above, steps = heads[above], steps + 1
        for i in changed:
            # sums are formed anew, so that they do not depend on the order of the cuts
            s[i] = weights[i] + sum(s[j] for j in below[i])
        for i in {k, *changed, *(j for i in changed for j in below[i])}:
            measure(i)
    top = list(range(n))
    for i in reversed(_order(heads)):
        h = heads[i]
        top[i] = top[h] if 0 <= h < n else i
    done = set(_order(heads))
    for i in range(n):
        if i not in done:  # a cycle, and what hangs on none: the first token met twice
            j, seen = i, set()
            while j not in seen and 0 <= heads[j] < n:
                seen.add(j)
                j = heads[j]
            top[i] = min(seen) if j in seen else j
    for i in reversed(_order(heads)):
        h = heads[i]
        if 0 <= h < n:
            top[i] = top[h]
    root: dict[int, list[int]] = {}
    for i in range(n):
        root.setdefault(top[i], []).append(i)
    return sorted(root.values())


def root_path(heads: list[int], token: int) -> list[int]:
    """Positions from a token up to its root."""
    out = [token]
    while 0 <= heads[out[-1]] < len(heads) and len(out) <= len(heads):
        out.append(heads[out[-1]])
    return out


def sentence_trees(tokens: DataFrame) -> DataFrame:
    """(sent_uid, ws, heads, weights): tokens (sent_uid, pos, word, head_pos, score) gathered per sentence."""
    one = F.array_sort(F.collect_list(F.struct("pos", "word", "head_pos", F.coalesce("score", F.lit(0.0)).alias("score"))))
    per = tokens.groupBy("sent_uid").agg(one.alias("ts"))
    return per.select("sent_uid", F.transform("ts", lambda t: t.word).alias("ws"), F.transform("ts", lambda t: t.head_pos).alias("heads"), F.transform("ts", lambda t: t.score).alias("weights"))


def fragilities(trees: DataFrame, with_fragility: bool = True) -> DataFrame:
    """(sent_uid, pos, subtree[, fragility])."""
    names = ["sent_uid", "pos", "subtree", *["fragility"] * with_fragility]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            columns: dict[str, list] = {c: [] for c in names}
            for s, h, w in zip(pdf["sent_uid"], pdf["heads"], pdf["weights"], strict=True):
                h, w = h.tolist(), w.tolist()
                columns["sent_uid"] += [s] * len(h)
                columns["pos"] += range(len(h))
                sums = subtree_sums(h, w)
                columns["subtree"] += sums
                if with_fragility:
                    columns["fragility"] += [_fragile(a, sums[k] if 0 <= k < len(h) else 0.0, x) for a, k, x in zip(sums, h, w, strict=True)]
            yield pd.DataFrame(columns)

    schema = "sent_uid long, pos int, subtree double" + ", fragility double" * with_fragility
    return trees.select("sent_uid", "heads", "weights").mapInPandas(run, schema)


def segment(trees: DataFrame, cutoff: float, longest: int | None = None) -> DataFrame:
    """(sent_uid, phrase_no, positions, ws, score) of all sentences, or of those of at most ``longest`` tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s, ws, h, w in zip(pdf["sent_uid"], pdf["ws"], pdf["heads"], pdf["weights"], strict=True):
                for k, p in enumerate(phrases(list(h), list(w), cutoff)):
                    rows.append((s, k, p, [ws[i] for i in p], float(sum(w[i] for i in p))))
            yield pd.DataFrame(rows, columns=["sent_uid", "phrase_no", "positions", "ws", "score"])

    if longest is not None:
        trees = trees.filter(F.size("ws") <= longest)
    return trees.mapInPandas(run, "sent_uid long, phrase_no int, positions array<int>, ws array<string>, score double")


def suggest(phrase_rows: DataFrame, ideas: DataFrame, most: int = 21) -> DataFrame:
    """(idea, suggestion, n, rank): phrases of 2 to 10 words around a word, by importance * sqrt(count) * length^-1.5.

    Phrases are counted as bags of words; a bag shows its shortest, then first, form.  Bags of one word or one use are skipped.
    """
    p = phrase_rows.filter((F.size("ws") >= 2) & (F.size("ws") <= 10)).select("sent_uid", "phrase_no", "ws", "score", F.explode(F.array_distinct("ws")).alias("idea"))
    p = p.join(ideas.select(F.col("word").alias("idea")), "idea", "left_semi")
    text = F.array_join("ws", " ")
    bags = p.groupBy("idea", F.array_join(F.array_sort("ws"), "\x00").alias("bag")).agg(
        F.count("*").alias("n"), F.first("score").alias("score"), F.min(F.struct(F.length(text).alias("k"), text.alias("suggestion"), F.size("ws").alias("words"))).alias("b")
    )
    bags = bags.filter("n >= 2")
    weight = F.round(F.col("score") * F.sqrt("n") * F.pow(F.col("b.words").cast("double"), F.lit(-1.5)), 9)
    from pyspark.sql import Window

    w = Window.partitionBy("idea").orderBy(weight.desc(), F.col("b.suggestion"))
    return bags.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < most).select("idea", "b.suggestion", "n", "rank")
