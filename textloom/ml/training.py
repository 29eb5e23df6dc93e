"""Vectors trained by negative sampling: words by skip-gram or continuous bags of words, sentences together with words.

Every epoch the tasks train copies of the model on their rows, and the copies are averaged by Spark, row by row of the
model, so one averaged model comes to the driver and not one a task.  The model has a bounded vocabulary.  A mini-batch of
rows is one matrix product; its steps add up where a word occurs several times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import workspace

MODEL = "i int, k double, a array<float>, b array<float>"


class Model:
    """Inner and outer vectors of words, and where negatives are drawn from."""

    def __init__(self, counts: np.ndarray, size: int, seed: int = 1, power: float = 0.75):
        n = len(counts)
        self.inner = ((np.random.default_rng(seed).random((n, size)) - 0.5) / size).astype(np.float32)
        self.outer = np.zeros((n, size), np.float32)
        self.noise = np.cumsum(np.asarray(counts, float) ** power)
        self.counts = np.asarray(counts, float)

    def negatives(self, rng: np.random.Generator, rows: int, each: int) -> np.ndarray:
        return np.minimum(np.searchsorted(self.noise, rng.random((rows, each)) * self.noise[-1], side="right"), len(self.noise) - 1)


class Step:
    """How a gradient becomes a change: with a plain rate, or one that shrinks per number by what it has moved (AdaGrad)."""

    def __init__(self, rate: float, adaptive: bool = False):
        self.rate, self.adaptive, self.seen = rate, adaptive, {}

    def add(self, to: np.ndarray, at: np.ndarray, g: np.ndarray, name: str) -> None:
        if self.adaptive:
            seen = self.seen.setdefault(name, np.zeros_like(to))
            np.add.at(seen, at, g * g)
            g = g / np.sqrt(seen[at] + 1e-8)
        np.add.at(to, at, (self.rate * g).astype(to.dtype))


def _batch(h: np.ndarray, targets: np.ndarray, m: Model, rng: np.random.Generator, negatives: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient of h, outer rows, their gradients) of the log-likelihood of one right target and some drawn ones."""
    drawn = m.negatives(rng, len(h), negatives)
    rows = np.c_[targets, drawn]
    right = np.zeros(rows.shape, np.float32)
    right[:, 0] = 1
    right[:, 1:] = drawn == targets[:, None]
    out = m.outer[rows]
    miss = right - 1 / (1 + np.exp(-np.clip(np.einsum("bd,bkd->bk", h, out), -30, 30)))
    return np.einsum("bk,bkd->bd", miss, out), rows.ravel(), (miss[:, :, None] * h[:, None, :]).reshape(-1, h.shape[1])


def _averaged(parts: DataFrame, m: Model) -> float:
    """Takes the mean of the tasks' models, weighted by their rows, into the model; the weight of all."""
    zero = F.array_repeat(F.lit(0.0), m.inner.shape[1])
    weighted = parts.select("i", "k", *[F.transform(c, lambda x: x * F.col("k")).alias(c) for c in ("a", "b")])
    sums = [F.aggregate(F.collect_list(c), zero, lambda s, v: F.zip_with(s, v, lambda p, q: p + q)).alias(c) for c in ("a", "b")]
    summed = weighted.groupBy("i").agg(F.sum("k").alias("rows"), *sums)
    rows = summed.orderBy("i").collect()  # a row per word of the bounded vocabulary
    for r in rows:
        m.inner[r["i"]], m.outer[r["i"]] = np.asarray(r["a"]) / r["rows"], np.asarray(r["b"]) / r["rows"]
    return sum(r["rows"] for r in rows)


def _model_rows(k: float, inner: np.ndarray, outer: np.ndarray, touched: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"i": touched.astype(np.int32), "k": k, "a": list(inner[touched]), "b": list(outer[touched])})


def train_words(
    rows: DataFrame, counts: np.ndarray, size: int = 50, mode: str = "skip", epochs: int = 3, rate: float = 0.025, negatives: int = 5,
    subsample: float | None = None, adaptive: bool = False, seed: int = 1, batch: int = 256,
) -> Model:
    """Word vectors from rows (word int, context array<int>): "skip" predicts each context from the word, "bag" the word
    from the mean of its contexts.  The rate falls to nothing over the epochs; with ``subsample`` frequent words are left out
    at random, by a hash of the row, with the usual probability.

    Empty contexts give nothing; a task touches only the words of its rows, and only those are averaged.
    """
    if mode not in ("skip", "bag"):
        raise ValueError("mode is skip or bag")
    m = Model(counts, size, seed)
    share = m.counts / max(1.0, m.counts.sum())
    keep = np.ones(len(counts)) if subsample is None else np.minimum(1, (np.sqrt(share / subsample) + 1) * subsample / np.maximum(share, 1e-12))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)

        def train(batches: Iterator[pd.DataFrame], m: Model = m, step: float = step, epoch: int = epoch) -> Iterator[pd.DataFrame]:
            rng = np.random.default_rng(seed * 1000 + epoch)
            used, how = np.zeros(len(m.inner), bool), Step(step, adaptive)
            k = 0
            for pdf in batches:
                words = pdf["word"].to_numpy()
                contexts = [np.asarray(c, np.int64) for c in pdf["context"]]
                if subsample is not None:
                    contexts = [c[rng.random(len(c)) < keep[c]] for c in contexts]
                    left = rng.random(len(words)) < keep[words]
                    words, contexts = words[left], [c for c, x in zip(contexts, left, strict=True) if x]
                for at in range(0, len(words), batch):
                    w, cs = words[at : at + batch], contexts[at : at + batch]
                    n = np.array([len(c) for c in cs])
                    flat = np.concatenate(cs) if n.sum() else np.zeros(0, np.int64)
                    if not len(flat):
                        continue
                    k += len(flat)
                    if mode == "skip":
                        centre = np.repeat(w, n)
                        g, out, g_out = _batch(m.inner[centre], flat, m, rng, negatives)
                        how.add(m.inner, centre, g, "inner")
                        used[centre] = True
                    else:
                        some = n > 0
                        row = np.repeat(np.arange(some.sum()), n[some])
                        mean = np.zeros((some.sum(), size), np.float32)
                        np.add.at(mean, row, m.inner[flat])
                        mean /= n[some][:, None]
                        g, out, g_out = _batch(mean, w[some], m, rng, negatives)
                        how.add(m.inner, flat, g[row], "inner")
                        used[flat] = True
                    how.add(m.outer, out, g_out, "outer")
                    used[out] = True
            if k:
                yield _model_rows(float(k), m.inner, m.outer, np.flatnonzero(used))

        if not _averaged(rows.select("word", "context").mapInPandas(train, MODEL), m):
            break
    return m


def train_sentences(
    sentences: DataFrame, counts: np.ndarray, size: int = 50, epochs: int = 5, rate: float = 0.05, decay: float = 0.95, negatives: int = 5,
    window: int = 5, adaptive: bool = False, seed: int = 1,
) -> tuple[DataFrame, Model]:
    """((sent_uid, vec), model): vectors of sentences (sent_uid long, ws array<int>) and words, trained jointly.

    The vector of a sentence and those of the words around predict each word.  A sentence's vector stays with its row,
    in a table that every epoch rewrites; word vectors are averaged over the tasks.  The rate falls by ``decay`` an epoch.
    Words below 0 are unknown and left out; a sentence without known words keeps its first vector.
    """
    m = Model(counts, size, seed)
    schema = f"sent_uid long, ws array<int>, vec array<float>, {MODEL}"
    start = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda j: (F.pmod(F.xxhash64("sent_uid", j, F.lit(seed)), F.lit(10_000)) / 10_000 - 0.5).cast("float") / size)
    table = sentences.select("sent_uid", "ws", start.cast("array<float>").alias("vec"))
    last: DataFrame | None = None
    for epoch in range(epochs):
        step = rate * decay**epoch

        def train(batches: Iterator[pd.DataFrame], m: Model = m, step: float = step, epoch: int = epoch) -> Iterator[pd.DataFrame]:
            rng = np.random.default_rng(seed * 1000 + epoch)
            used, how = np.zeros(len(m.inner), bool), Step(step, adaptive)
            k = 0
            for pdf in batches:
                vectors = []
                for ws, v in zip(pdf["ws"], pdf["vec"], strict=True):
                    v = np.array(v, np.float32)
                    ws = np.asarray([] if ws is None else ws, np.int64)
                    ws = ws[ws >= 0]
                    n = len(ws)
                    if n:
                        place = np.arange(n)[:, None] + np.r_[-window:0, 1 : window + 1]
                        inside = (place >= 0) & (place < n)
                        around = ws[np.clip(place, 0, n - 1)]
                        sums = (m.inner[around] * inside[:, :, None]).sum(axis=1) + v
                        parts = (inside.sum(axis=1) + 1).astype(np.float32)[:, None]
                        g, out, g_out = _batch(sums / parts, ws, m, rng, negatives)
                        how.add(m.outer, out, g_out, "outer")
                        share = g / parts
                        row, at = np.nonzero(inside)
                        how.add(m.inner, around[row, at], share[row], "inner")
                        used[out] = used[ws] = True
                        v += step * share.sum(axis=0)
                        k += n
                    vectors.append(v)
                yield pdf[["sent_uid", "ws"]].assign(vec=vectors, i=None, k=None, a=None, b=None)
            if k:
                yield _model_rows(float(k), m.inner, m.outer, np.flatnonzero(used)).assign(sent_uid=None, ws=None, vec=None)[["sent_uid", "ws", "vec", "i", "k", "a", "b"]]

        done = workspace.materialise(table.mapInPandas(train, schema), "sentence-vectors")
        _averaged(done.filter("i is not null").select("i", "k", "a", "b"), m)
        if last is not None:
            workspace.discard(last)
        last = done
        table = done.filter("i is null").select("sent_uid", "ws", "vec")
    return table.select("sent_uid", "vec"), m


def objective(pairs: DataFrame, vectors: dict[int, np.ndarray], noise: np.ndarray, negatives: int = 5, seed: int = 1, reuse: bool = False) -> float:
    """Mean of ln sigmoid(cos(word, context)) + the sum over drawn words of ln sigmoid(-cos(word, drawn)), of pairs (word,
    context).  With ``reuse`` the context stands in the place of every drawn word."""
    cumulative = np.cumsum(noise)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        unit = {k: v / max(1e-12, float(np.linalg.norm(v))) for k, v in vectors.items()}
        total, n = 0.0, 0
        for pdf in batches:
            for w, c in zip(pdf["word"], pdf["context"], strict=True):
                if w not in unit or c not in unit:
                    continue
                drawn = np.searchsorted(cumulative, rng.random(negatives) * cumulative[-1], side="right")
                others = [unit[c]] * negatives if reuse else [unit[int(x)] for x in drawn if int(x) in unit]
                total -= np.log1p(np.exp(-(unit[w] @ unit[c]))) + sum(np.log1p(np.exp(unit[w] @ o)) for o in others)
                n += 1
        yield pd.DataFrame({"total": [float(total)], "n": [n]})

    got = pairs.select("word", "context").mapInPandas(part, "total double, n long").agg(F.sum("total"), F.sum("n")).first()
    return got[0] / got[1] if got[1] else 0.0


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 100, memory: int = 10, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """(place, value) of a smooth function's minimum by L-BFGS: two-loop recursion, line search by bisection.

    f gives value and gradient; on a cluster it is a summed partial of every task.
    """
    x = np.array(x, float)
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.linalg.norm(g) <= tolerance * max(1.0, float(np.linalg.norm(x))):
            break
        q, alphas = g.copy(), []
        for s, y, rho in reversed(past):
            a = rho * (s @ q)
            alphas.append(a)
            q -= a * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - rho * (y @ q))
        slope, t = -(g @ q), 1.0
        if slope >= 0:  # no way down: start again along the gradient
            q, slope, past = g.copy(), -(g @ g), []
        low, high = 0.0, np.inf
        for _ in range(60):  # bisection for a step that is low enough and past the steepest part
            new = x - t * q
            new_value, new_g = f(new)
            if not new_value <= value + 1e-4 * t * slope:
                high = t
            elif -(new_g @ q) < 0.9 * slope:
                low = t
            else:
                break
            t = 2 * t if high == np.inf else (low + high) / 2
        if not new_value < value:
            break
        s, y = new - x, new_g - g
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        x, value, g = new, new_value, new_g
    return x, value
