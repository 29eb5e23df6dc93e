"""Recursive merging of word vectors into phrase vectors and trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.trees import Tree, show


@dataclass
class Merger:
    """phrase = tanh(W [left; right] + b); score = u . phrase / |u|."""

    w: np.ndarray
    b: np.ndarray
    u: np.ndarray

    @classmethod
    def random(cls, dim: int, seed: int = 0) -> Merger:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 1 / np.sqrt(2 * dim), (dim, 2 * dim)), np.zeros(dim), rng.normal(0, 1, dim))

    def phrase(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.tanh(self.w @ np.concatenate([left, right]) + self.b)

    def score(self, phrase: np.ndarray) -> float:
        return float(self.u @ phrase / np.linalg.norm(self.u))


@dataclass
class ContextMerger(Merger):
    """A merger that also sees the nodes beside the pair: tanh(W [left; right] + V [before; after] + b), zeros at the edges."""

    v: np.ndarray | None = None

    @classmethod
    def random(cls, dim: int, seed: int = 0) -> ContextMerger:
        m = Merger.random(dim, seed)
        return cls(m.w, m.b, m.u, np.random.default_rng(seed + 1).normal(0, 0.5 / np.sqrt(2 * dim), (dim, 2 * dim)))

    def phrase_in(self, left: np.ndarray, right: np.ndarray, before: np.ndarray | None, after: np.ndarray | None) -> np.ndarray:
        zero = np.zeros(len(self.b))
        beside = np.concatenate([zero if before is None else before, zero if after is None else after])
        return np.tanh(self.w @ np.concatenate([left, right]) + self.v @ beside + self.b)


def greedy_in_context(m: ContextMerger, words: list[str], vectors: list[np.ndarray]) -> tuple[Tree, float]:
    """Greedy parse in which a pair's phrase depends on its neighbours."""
    nodes: list[tuple[Tree, np.ndarray]] = list(zip(words, vectors, strict=True))
    total = 0.0
    while len(nodes) > 1:
        n = len(nodes)
        made = [m.phrase_in(nodes[i][1], nodes[i + 1][1], nodes[i - 1][1] if i else None, nodes[i + 2][1] if i + 2 < n else None) for i in range(n - 1)]
        scores = [m.score(p) for p in made]
        k = int(np.argmax(scores))
        total += scores[k]
        nodes[k : k + 2] = [((nodes[k][0], nodes[k + 1][0]), made[k])]
    return nodes[0][0], total


def greedy(m: Merger, words: list[str], vectors: list[np.ndarray]) -> tuple[Tree, float]:
    """Merges the best neighbouring pair until one node is left; the score is the sum over merges, ties go to the first pair.

    Pairs wait in a heap; a merge makes two new ones, and outdated ones are passed over.
    """
    n = len(words)
    node: list[Tree] = list(words)
    vec, after, before = list(vectors), list(range(1, n + 1)), list(range(-1, n - 1))
    version = [0] * n  # a node keeps the number of its first word
    heap: list[tuple[float, int, int, int, np.ndarray]] = []

    def offer(i: int) -> None:
        j = after[i]
        p = m.phrase(vec[i], vec[j])
        heapq.heappush(heap, (-m.score(p), i, version[i], version[j], _Kept(p)))

    for i in range(n - 1):
        offer(i)
    total, left = 0.0, n
    while left > 1:
        s, i, vi, vj, p = heapq.heappop(heap)
        j = after[i]
        if version[i] != vi or j >= n or version[j] != vj:
            continue
        total -= s
        node[i], vec[i] = (node[i], node[j]), p.vector
        version[i] += 1
        version[j] = -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        left -= 1
        if after[i] < n:
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    return node[0], total


class _Kept:
    """A vector that a heap carries and never compares."""

    __slots__ = ("vector",)

    def __init__(self, vector: np.ndarray):
        self.vector = vector

    def __lt__(self, other: object) -> bool:
        return False


def chart(m: Merger, words: list[str], vectors: list[np.ndarray], penalty: float = 0.0, against: set[tuple[int, int]] | None = None) -> tuple[Tree, float]:
    """(tree, its score): best tree over all spans by dynamic programming over one vector per span; spans outside ``against``
    cost the penalty.  A span keeps one vector, so the greedy tree can be better; then it is given."""
    n = len(words)
    best: dict[tuple[int, int], tuple[float, Tree, np.ndarray]] = {(i, i): (0.0, words[i], vectors[i]) for i in range(n)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            j = i + size - 1
            options = []
            for k in range(i, j):
                a, b = best[(i, k)], best[(k + 1, j)]
                p = m.phrase(a[2], b[2])
                s = a[0] + b[0] + m.score(p)
                if against is not None and (i, j) not in against:
                    s -= penalty
                options.append((s, (a[1], b[1]), p))
            best[(i, j)] = max(options, key=lambda x: x[0])
    s, tree, _ = best[(0, n - 1)]
    if penalty == 0:
        other, high = greedy(m, words, vectors)
        if high > s:
            return other, high
    return tree, s


def score_gradient(m: Merger, tree: Tree, vector_of) -> tuple[float, dict[str, np.ndarray]]:
    """Score of a tree and its gradient in w, b and u."""
    g = {"w": np.zeros_like(m.w), "b": np.zeros_like(m.b), "u": np.zeros_like(m.u)}
    norm = float(np.linalg.norm(m.u))
    total = 0.0

    def forward(t: Tree) -> tuple[np.ndarray, object]:
        nonlocal total
        if not isinstance(t, tuple):
            return vector_of(t), None
        lv, lt = forward(t[0])
        rv, rt = forward(t[1])
        p = m.phrase(lv, rv)
        total += m.score(p)
        return p, (lv, lt, rv, rt, p)

    def backward(saved: object, above: np.ndarray) -> None:
        if saved is None:
            return
        lv, lt, rv, rt, p = saved
        g["u"] += p / norm - m.u * (m.u @ p) / norm**3
        d = (above + m.u / norm) * (1 - p * p)
        x = np.concatenate([lv, rv])
        g["w"] += np.outer(d, x)
        g["b"] += d
        down = m.w.T @ d
        backward(lt, down[: len(lv)])
        backward(rt, down[len(lv) :])

    p, saved = forward(tree)
    backward(saved, np.zeros_like(p))
    return total, g


class AdaGrad:
    def __init__(self, rate: float = 0.05, epsilon: float = 1e-8):
        self.rate, self.epsilon, self.seen = rate, epsilon, {}

    def step(self, values: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        for k, g in grads.items():
            self.seen[k] = self.seen.get(k, 0) + g * g
            values[k] += self.rate * g / (np.sqrt(self.seen[k]) + self.epsilon)


class RmsProp:
    def __init__(self, rate: float = 0.01, decay: float = 0.9, epsilon: float = 1e-8):
        self.rate, self.decay, self.epsilon, self.seen = rate, decay, epsilon, {}

    def step(self, values: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        for k, g in grads.items():
            self.seen[k] = self.decay * self.seen.get(k, 0) + (1 - self.decay) * g * g
            values[k] += self.rate * g / (np.sqrt(self.seen[k]) + self.epsilon)


class DecayingSgd:
    def __init__(self, rate: float = 0.1, decay: float = 0.01):
        self.rate, self.decay, self.turn = rate, decay, 0

    def step(self, values: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        rate = self.rate / (1 + self.decay * self.turn)
        self.turn += 1
        for k, g in grads.items():
            values[k] += rate * g


def hashed_vector(word: str, dim: int) -> np.ndarray:
    """A vector of a word's own, drawn by a hash: for parses without a trained vocabulary."""
    import zlib

    return np.random.default_rng(zlib.crc32(word.encode("utf-8", "surrogatepass"))).normal(0, 1, dim)


def parse_sentences(sentences: DataFrame, vectors: dict[str, np.ndarray] | None, m: Merger, how: str = "greedy", longest: int | None = None) -> DataFrame:
    """(sent_uid, tree, score) of sentences (sent_uid, ws), if told so of at most ``longest`` words; unknown words are zero
    vectors, without a vocabulary each word has a hashed one.  Brackets in words show as ⟨ and ⟩, those of the tree are round.

    The word vectors go to the tasks with the function: a vocabulary of bounded size.
    """
    dim = len(m.b)
    zero = np.zeros(dim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, np.ndarray] = {}
        for pdf in batches:
            rows = []
            for s, ws in zip(pdf["sent_uid"], pdf["ws"], strict=True):
                ws = list(ws)
                if vectors is None:
                    vs = [own[w] if w in own else own.setdefault(w, hashed_vector(w, dim)) for w in ws]
                    if len(own) > 100_000:
                        own.clear()
                else:
                    vs = [vectors.get(w, zero) for w in ws]
                ws = [w.replace("(", "⟨").replace(")", "⟩") for w in ws]
                tree, score = greedy(m, ws, vs) if how == "greedy" else chart(m, ws, vs)
                rows.append((s, show(tree), score))
            yield pd.DataFrame(rows, columns=["sent_uid", "tree", "score"])

    fits = F.size("ws") > 0 if longest is None else F.size("ws").between(1, longest)
    return sentences.filter(fits).select("sent_uid", "ws").mapInPandas(run, "sent_uid long, tree string, score double")


def minibatch_gradient(trees: DataFrame, vectors: dict[str, np.ndarray], m: Merger) -> tuple[float, dict[str, np.ndarray]]:
    """Summed score and gradient over a table of trees (tree string): one partial per task, merged in a tree of tasks."""
    from textloom.functions.trees import parse_tree

    zero = np.zeros(len(m.b))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, grads = 0.0, None
        for pdf in batches:
            for t in pdf["tree"]:
                s, g = score_gradient(m, parse_tree(t), lambda w: vectors.get(w, zero))
                total += s
                grads = g if grads is None else {k: grads[k] + g[k] for k in g}
        if grads is not None:
            yield pd.DataFrame([{"score": total, **{k: v.ravel().tolist() for k, v in grads.items()}}])

    schema = "score double, w array<double>, b array<double>, u array<double>"
    parts = trees.select("tree").mapInPandas(part, schema).collect()  # one row per task, of the size of the model
    if not parts:
        return 0.0, {"w": np.zeros_like(m.w), "b": np.zeros_like(m.b), "u": np.zeros_like(m.u)}
    grads = {k: sum(np.array(r[k]) for r in parts).reshape(getattr(m, k).shape) for k in ("w", "b", "u")}
    return float(sum(r["score"] for r in parts)), grads
