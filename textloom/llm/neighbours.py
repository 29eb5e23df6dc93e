"""Most similar vectors for every vector: NN-descent over Spark joins, and greedy search on the graph.

* Vectors are normalised and kept as 100 signed bytes each (an error of about 0.001 in the cosine), so joins move a
  quarter of the floats.  Exact copies are represented by the one of smallest id.
* *Start.* Landmarks are drawn from a bounded sample; every vector goes to the cells of its ``probes`` nearest landmarks,
  and each cell gives its members' first lists by blocked matrix products.  Cells hold about the square root of the vectors,
  up to a bound.  Cells that the sample shows to be crowded are
  split by further hyperplanes, and a cell that is still larger is worked off in runs of bounded length.
* *Descent.* Lists hold ``width`` neighbours, more than the k that are asked for.  In every round each node gathers a
  sample of its new and of its old neighbours, forward and reverse; new ones are compared with each other and with the
  old, and whatever is closer than the last of a list enters that list as new.  Samples are drawn by a hash that changes
  with the round, so a popular node meets other visitors every time.  Rounds end when few lists change.
* The nodes are hashed to blocks; a step of a round is a join of tables by block: edges to the blocks of their ends,
  requests for vectors to the blocks that have them, vectors to the blocks that compare them (each once for a block, not
  for each visit), closer neighbours to the blocks of the lists.  A round runs in ``waves`` over the comparing blocks, so
  that only a part of its vectors is on the way at a time.
* *Search.* All queries walk the graph together, along edges of both directions, from the nearest of a bounded sample of
  nodes, until none of them has an open node among its ``beam`` best.

Defined cases: vectors that are null, of another length, with nulls, not finite or all zero are no nodes; equal
similarities go to the smaller id; a vector has its copies as neighbours first; fewer than two vectors give no pairs;
repeated ids keep one vector; words and further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import workspace
from textloom.llm import blocks
from textloom.llm.blocks import Inbox, Row

#: kinds of messages
RAW, NODE, LIST, CANDIDATE, EDGE, VISIT, NEED, LAST, VECTOR, LINK, STATE, ASK, ANSWER = range(13)
#: flags of list entries: joined before, new, new and drawn for the coming round
OLD, NEW, DRAWN = 0, 1, 3

def _matrix(column: pa.ChunkedArray | pa.Array, width: int, dtype: type = np.int8) -> np.ndarray:
    """The rows of a binary column of equal widths, without a copy per row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.zeros((0, width), dtype)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    if len(rows) == 0:
        return pa.array([], pa.binary())
    offsets = pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows)])

def pack_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, vec, copy): the valid vectors, normalised to signed bytes; copy is a hash of the exact vector."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            column = b.column(1)
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            full = np.nan_to_num(lengths, nan=-1) == dim
            column, ids = column.filter(pa.array(full)), b.column(0).filter(pa.array(full))
            flat = column.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
            with np.errstate(all="ignore"):
                norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                good = np.isfinite(norm) & (norm > 0)
                x, norm = x[good], norm[good]
                unit = x / norm[:, None]
            unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
            top = np.abs(unit).max(axis=1, initial=1e-30)
            q = np.rint(unit * (127 / top)[:, None]).astype(np.int8)
            exact = np.ascontiguousarray(x.astype(np.float32))
            copy = [xxhash.xxh3_128_digest(r) for r in exact]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)).cast(pa.int64()), _binary(q), pa.array(copy, pa.binary())], ["id", "vec", "copy"])

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec")).filter("id is not null and vec is not null")
    return rows.mapInArrow(pack, "id long, vec binary, copy binary")


def _unit(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.float32)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x

class Cells:
    """Landmarks, and for the crowded cells further hyperplanes."""

    def __init__(self, sample: np.ndarray, n: int, cell_rows: int, probes: int, max_cells: int):
        want = int(min(max_cells, max(1, n * probes // cell_rows), len(sample)))
        self.probes = min(probes, want)
        self.landmarks = sample[:want]
        rest = sample
        near = np.argpartition(-(rest @ self.landmarks.T), self.probes - 1, axis=1)[:, : self.probes] if want > self.probes else np.tile(np.arange(want), (len(rest), 1))
        share = np.bincount(near.ravel(), minlength=want) / max(1, len(rest))
        # a cell with more than four times the wanted rows is halved until it has about twice as many
        self.bits = np.maximum(0, np.ceil(np.log2(np.maximum(1e-9, share * n / (2 * cell_rows))))).astype(np.int64)
        self.bits[share * n <= 4 * cell_rows] = 0
        rng = np.random.default_rng(11)
        self.planes = rng.standard_normal((max(1, int(self.bits.max(initial=0))), sample.shape[1])).astype(np.float32)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cells of each vector: (rows, probes) numbers."""
        if len(self.landmarks) > self.probes:
            score = x @ self.landmarks.T
            near = np.argpartition(-score, self.probes - 1, axis=1)[:, : self.probes]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), axis=1), 1)  # nearest first
        else:
            near = np.tile(np.arange(len(self.landmarks)), (len(x), 1))
        cells = near.astype(np.int64) << 32
        if self.bits.any():
            side = x @ self.planes.T
            offset = self.landmarks @ self.planes.T
            for p in range(near.shape[1]):
                c = near[:, p]
                above = side > offset[c]
                for b in range(self.planes.shape[0]):
                    cells[:, p] += np.where((self.bits[c] > b) & above[:, b], 1 << b, 0)
        return cells


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """A hash of 32 bits of the parts together."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(29))
    return (h >> np.uint64(32)).astype(np.int64)


def _places(group: np.ndarray) -> np.ndarray:
    """The place of each item within its group; equal groups stand together."""
    if not len(group):
        return np.zeros(0, np.int64)
    begin = np.r_[True, group[1:] != group[:-1]]
    at = np.arange(len(group))
    return at - np.maximum.accumulate(np.where(begin, at, 0))


def _table(group: np.ndarray, item: np.ndarray, priority: np.ndarray, n_groups: int, most: int) -> np.ndarray:
    """(n_groups, most): the items of smallest priority of each group, -1 where there are no more."""
    order = np.argsort((group.astype(np.int64) << 32) | priority)
    group, item = group[order], item[order]
    place = _places(group)
    keep = place < most
    out = np.full((n_groups, most), -1, item.dtype)
    out[group[keep], place[keep]] = item[keep]
    return out


def _drawn(gids: np.ndarray, nbrs: np.ndarray, flags: np.ndarray, flag: int, turn: int, most: int) -> np.ndarray:
    """(nodes, most) places in the lists of entries with the flag, drawn by a hash; -1 where there are no more."""
    h = np.where((flags == flag) & (nbrs >= 0), _mix(gids[:, None], nbrs, turn), 1 << 40)
    places = np.argsort(h, axis=1)[:, :most]
    return np.where(np.take_along_axis(h, places, 1) < 1 << 40, places, -1)


class Shape:
    """What all steps of a descent have to know."""

    def __init__(self, dim: int, n: int, n_blocks: int, width: int, sample: int):
        self.dim, self.n_blocks, self.width, self.sample = dim, n_blocks, width, sample
        self.gid = np.int32 if n * 2 < 2**31 else np.int64  # numbers of nodes: block + n_blocks * place within the block

    def list_rows(self, inbox: Inbox, kind: int = LIST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w = self.width
        got = inbox.get(kind, (self.gid, 0), (self.gid, w), (np.float32, w), (np.int8, w), (np.int64, 0))
        order = np.argsort(got[0])
        return tuple(x[order] for x in got)

    def lists(self, block: int, gids: np.ndarray, nbrs: np.ndarray, sims: np.ndarray, flags: np.ndarray, ids: np.ndarray, fresh: int, rows: int = 8192) -> Iterator[Row]:
        for at in range(0, len(gids), rows):
            part = slice(at, at + rows)
            yield blocks.pack(block, LIST, 0 if at else fresh, gids[part], nbrs[part], sims[part], flags[part], ids[part])


def _numbered(nodes: DataFrame, dim: int, n_blocks: int) -> DataFrame:
    """The nodes (id, vec) hashed to blocks and numbered there: messages NODE of gids, ids, bytes and inverse norms."""

    def scatter(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            yield from blocks.batches(blocks.send(RAW, _mix(ids) % n_blocks, ids, _matrix(b.column(1), dim)))

    def number(inbox: Inbox) -> Iterator[Row]:
        ids, vec = inbox.get(RAW, (np.int64, 0), (np.int8, dim))
        order = np.argsort(ids)
        ids, vec = ids[order], vec[order]
        gids = inbox.block + n_blocks * np.arange(len(ids), dtype=np.int64)
        inverse = 1 / np.sqrt(np.einsum("ij,ij->i", vec, vec, dtype=np.float32))
        for at in range(0, len(ids), 8192):
            part = slice(at, at + 8192)
            yield blocks.pack(inbox.block, NODE, 0, gids[part], ids[part], vec[part], inverse[part].astype(np.float32))

    return blocks.at_blocks([nodes.select("id", "vec").mapInArrow(scatter, blocks.MESSAGE)], n_blocks, number)


def _unpacked(numbered: DataFrame, dim: int) -> DataFrame:
    """(id, vec, copy) of the nodes, none of which has copies."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, vec in zip(b.column(0), b.column(1), strict=True):
                own = np.frombuffer(ids.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), _binary(np.frombuffer(vec.as_buffer(), np.int8).reshape(-1, dim)), _binary(own.reshape(-1, 1))], ["id", "vec", "copy"])

    return numbered.select("b", "c").mapInArrow(rows, "id long, vec binary, copy binary")


def _cell_candidates(nodes: DataFrame, cells: Cells, shape: Shape, longest: int) -> DataFrame:
    """The nearest members of each of its cells for every node, as messages CANDIDATE to the blocks of the lists."""
    dim, gid = shape.dim, shape.gid
    most = max(12, shape.width * 12 // (5 * cells.probes))  # a node's cells together give more than its list takes

    def assign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for g, v in zip(b.column("a"), b.column("c"), strict=True):
                gids, q = np.frombuffer(g.as_buffer(), np.int64), np.frombuffer(v.as_buffer(), np.int8).reshape(-1, dim)
                c = cells.of(_unit(q))
                row = np.repeat(np.arange(len(q)), c.shape[1])
                cell = c.ravel()
                order = np.argsort(cell, kind="stable")
                cell, row = cell[order], row[order]
                cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
                names, members, vectors = [], [], []
                for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                    for at in range(s, e, longest):
                        part = row[at : min(e, at + longest)]
                        names.append(int(cell[s]))
                        members.append(gids[part].astype(gid).tobytes())
                        vectors.append(q[part].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(members, pa.binary()), pa.array(vectors, pa.binary())], ["cell", "a", "c"])

    def runs(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Members of a cell; of a cell beyond the longest run, in parts."""
        last, members, vectors, size = None, [], [], 0
        for b in rows:
            for cell, g, v in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if size and (cell != last or size + len(g.as_buffer()) // np.dtype(gid).itemsize > longest):
                    yield np.concatenate(members), np.concatenate(vectors)
                    members, vectors, size = [], [], 0
                last = cell
                members.append(np.frombuffer(g.as_py(), gid))
                vectors.append(np.frombuffer(v.as_py(), np.int8).reshape(-1, dim))
                size += len(members[-1])
        if size:
            yield np.concatenate(members), np.concatenate(vectors)

    def inside(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list) -> Iterator[pa.RecordBatch]:
            t, c, s = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from blocks.batches(blocks.send(CANDIDATE, t % shape.n_blocks, t, c, s))

        held, size = [], 0
        for own, q in runs(rows):
            m = _unit(q)
            take = min(most, len(m) - 1)
            for at in range(0, len(m) if take > 0 else 0, 1024):
                g = m[at : at + 1024] @ m.T
                g[np.arange(len(g)), np.arange(at, at + len(g))] = -2
                near = np.argpartition(g, g.shape[1] - take, axis=1)[:, -take:]
                held.append((np.repeat(own[at : at + 1024], take), own[near].ravel(), np.take_along_axis(g, near, 1).ravel()))
                size += near.size
            if size > 1_000_000:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    spread = nodes.select("a", "c").mapInArrow(assign, "cell long, a binary, c binary")
    return spread.repartition("cell").sortWithinPartitions("cell").mapInArrow(inside, blocks.MESSAGE)


def _merged(shape: Shape, turn: int, closing: bool) -> Callable[[Inbox], Iterator[Row]]:
    """Takes candidates into the lists of a block.  closing: the round ends, entries are drawn for the next one."""
    w, nb = shape.width, shape.n_blocks

    def run(inbox: Inbox) -> Iterator[Row]:
        gids, nbrs, sims, flags, ids = shape.list_rows(inbox)
        if not len(gids):  # the first time: lists are empty
            g, ids = inbox.get(NODE, (np.int64, 0), (np.int64, 0))
            order = np.argsort(g)
            gids, ids = g[order].astype(shape.gid), ids[order]
            nbrs, sims, flags = np.full((len(gids), w), -1, shape.gid), np.full((len(gids), w), -2, np.float32), np.zeros((len(gids), w), np.int8)
        t, c, s = inbox.get(CANDIDATE, (shape.gid, 0), (shape.gid, 0), (np.float32, 0))
        fresh = 0
        if len(t):
            # copies of a candidate, and entries that the list has already, are the same number
            row = (t // nb).astype(np.int64)
            touched = np.unique(row)
            has = nbrs[touched] >= 0
            r = np.r_[np.repeat(touched, w).reshape(-1, w)[has], row]
            n = np.r_[nbrs[touched][has].astype(np.int64), c.astype(np.int64)]
            v = np.r_[sims[touched][has], s]
            f = np.r_[flags[touched][has], np.full(len(c), -1, np.int8)]
            order = np.argsort(((r << 46 | n) << 1) | (f < 0))
            r, n, v, f = r[order], n[order], v[order], f[order]
            first = np.r_[True, (r[1:] != r[:-1]) | (n[1:] != n[:-1])]
            r, n, v, f = r[first], n[first], v[first], f[first]
            order = np.argsort(r << 32 | ((1.001 - v.astype(np.float64)) * 2**30).astype(np.int64), kind="stable")
            r, n, v, f = r[order], n[order], v[order], f[order]
            place = _places(r)
            keep = place < w
            r, n, v, f, place = r[keep], n[keep], v[keep], f[keep], place[keep]
            fresh = int((f < 0).sum())
            nbrs[touched], sims[touched], flags[touched] = -1, -2, OLD
            nbrs[r, place], sims[r, place], flags[r, place] = n, v, np.where(f < 0, NEW, f)
        if closing:
            flags[flags == DRAWN] = OLD
            p = _drawn(gids, nbrs, flags, NEW, turn + 1, shape.sample)
            at = np.nonzero(p >= 0)
            flags[at[0], p[at]] = DRAWN
        yield from shape.lists(inbox.block, gids, nbrs, sims, flags, ids, fresh)

    return run


def _sent_edges(shape: Shape, turn: int, wave: int, waves: int) -> Callable[[int, int, list], Iterator[Row]]:
    """Drawn edges to the blocks of their ends, as far as these take part in the wave, and the lists of such blocks."""
    w, s, nb, gid = shape.width, shape.sample, shape.n_blocks, shape.gid

    def run(block: int, kind: int, x: list) -> Iterator[Row]:
        gids, nbrs, flags = np.frombuffer(x[0], gid), np.frombuffer(x[1], gid).reshape(-1, w), np.frombuffer(x[3], np.int8).reshape(-1, w)
        for flag in (DRAWN, OLD):
            p = _drawn(gids, nbrs, flags, flag, turn, s)
            row, at = np.nonzero(p >= 0)
            end = nbrs[row, p[row, at]]
            mine = (end % nb) % waves == wave
            row, end = row[mine], end[mine]
            # of the edges to a popular node, each task sends as many as the node can take
            order = np.argsort((end.astype(np.int64) // nb << 32) | _mix(end, gids[row], turn))
            order = order[np.argsort(end[order], kind="stable")]
            keep = order[_places(end[order]) < s]
            yield from blocks.send(EDGE, end[keep] % nb, end[keep], gids[row[keep]], np.full(len(keep), flag, np.int8))
        if block % waves == wave:
            yield (block, LIST, 0, *[bytes(b) for b in x])

    return run


def _visits(shape: Shape, turn: int) -> Callable[[Inbox], Iterator[Row]]:
    """Who meets at each node: messages VISIT of gids, new and old visitors; NEED: vectors a block asks another one for."""
    s, nb, gid = shape.sample, shape.n_blocks, shape.gid

    def run(inbox: Inbox) -> Iterator[Row]:
        gids, nbrs, _, flags, _ = shape.list_rows(inbox)
        if not len(gids):
            return
        end, src, how = inbox.get(EDGE, (gid, 0), (gid, 0), (np.int8, 0))
        sides = []
        for flag in (DRAWN, OLD):
            p = _drawn(gids, nbrs, flags, flag, turn, s)
            forward = np.where(p >= 0, np.take_along_axis(nbrs, np.maximum(p, 0), 1), -1)
            e, v = end[how == flag], src[how == flag]
            reverse = _table((e // nb).astype(np.int64), v, _mix(e, v, turn), len(gids), s)
            both = np.sort(np.c_[forward, reverse], axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            sides.append(both)
        meets = (sides[0] >= 0).any(axis=1) & ((sides[0] >= 0).sum(axis=1) + (sides[1] >= 0).sum(axis=1) > 1)
        gids, sides = gids[meets], [x[meets] for x in sides]
        for at in range(0, len(gids), 4096):
            yield blocks.pack(inbox.block, VISIT, 0, gids[at : at + 4096], sides[0][at : at + 4096], sides[1][at : at + 4096])
        need = np.unique(np.concatenate([x.ravel() for x in sides])) if len(gids) else np.zeros(0, gid)
        need = need[need >= 0]
        yield from blocks.send(NEED, need % nb, need, np.full(len(need), inbox.block, np.int32))

    return run


def _last(shape: Shape) -> Callable[[int, int, list], Iterator[Row]]:
    def run(block: int, kind: int, x: list) -> Iterator[Row]:
        yield blocks.pack(block, LAST, 0, np.frombuffer(x[0], shape.gid), np.frombuffer(x[2], np.float32).reshape(-1, shape.width)[:, -1])

    return run


def _served(shape: Shape) -> Callable[[Inbox], Iterator[Row]]:
    """Answers the blocks' requests: messages VECTOR of gids, bytes, inverse norms and the lists' last similarities."""
    dim, nb = shape.dim, shape.n_blocks

    def run(inbox: Inbox) -> Iterator[Row]:
        gids, _, vec, inverse = inbox.get(NODE, (np.int64, 0), (np.int64, 0), (np.int8, dim), (np.float32, 0))
        order = np.argsort(gids)
        vec, inverse = vec[order], inverse[order]
        g, last = inbox.get(LAST, (shape.gid, 0), (np.float32, 0))
        worst = np.full(len(gids), -2, np.float32)
        worst[g // nb] = last
        need, block = inbox.get(NEED, (shape.gid, 0), (np.int32, 0))
        at = need // nb
        yield from blocks.send(VECTOR, block, need, vec[at], inverse[at], worst[at], items=1 << 14)

    return run


def _compared(shape: Shape, rows: int = 1024) -> Callable[[Inbox], Iterator[Row]]:
    """The local join: visitors of a node that are closer to each other than the last of their lists."""
    dim, s, nb, gid = shape.dim, shape.sample, shape.n_blocks, shape.gid

    def run(inbox: Inbox) -> Iterator[Row]:
        known, vec, inverse, worst = inbox.get(VECTOR, (gid, 0), (np.int8, dim), (np.float32, 0), (np.float32, 0))
        order = np.argsort(known)
        known, vec, inverse, worst = known[order], vec[order], inverse[order], worst[order]
        _, new, old = inbox.get(VISIT, (gid, 0), (gid, 2 * s), (gid, 2 * s))
        held, size = [], 0
        for at in range(0, len(new), rows):
            who = np.c_[new[at : at + rows], old[at : at + rows]]
            there = who >= 0
            # fewer columns where no node has that many visitors
            n_new, n_old = (int(x.sum(axis=1).max(initial=0)) for x in (there[:, : 2 * s], there[:, 2 * s :]))
            who = np.c_[np.sort(who[:, : 2 * s], axis=1)[:, 2 * s - n_new :], np.sort(who[:, 2 * s :], axis=1)[:, 2 * s - n_old :]]
            there = who >= 0
            idx = np.searchsorted(known, who)
            idx[~there] = 0
            x = vec[idx].astype(np.float32)
            x *= inverse[idx][:, :, None]
            g = np.matmul(x[:, :n_new], x.transpose(0, 2, 1))
            limit = np.where(there, worst[idx], np.float32(4))
            ok = (who[:, :n_new, None] != who[:, None, :]) & there[:, None, :] & there[:, :n_new, None]
            z, i, j = np.nonzero((g > limit[:, :n_new, None]) & ok)
            held.append((idx[z, i] << 32 | idx[z, j], g[z, i, j]))
            z, i, j = np.nonzero((g[:, :, n_new:] > limit[:, None, n_new:]) & ok[:, :, n_new:])
            held.append((idx[z, n_new + j] << 32 | idx[z, i], g[z, i, n_new + j]))
            size += len(held[-1][0]) + len(held[-2][0])
            if size > 4_000_000:
                yield from flush(held, known)
                held, size = [], 0
        if held:
            yield from flush(held, known)

    def flush(held: list, known: np.ndarray) -> Iterator[Row]:
        key, sim = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key)
        key, sim = key[order], sim[order]
        first = np.r_[True, key[1:] != key[:-1]][: len(key)]
        key, sim = key[first], sim[first]
        t, c = known[key >> 32], known[key & 0xFFFFFFFF]
        yield from blocks.send(CANDIDATE, t % nb, t, c, sim)

    return run


class Graph:
    """The neighbour graph of a set of vectors, in tables of the shared folder."""

    def __init__(self, packed: DataFrame, nodes: DataFrame, numbered: DataFrame | None, lists: DataFrame | None, shape: Shape | None, k: int, sample: tuple[np.ndarray, np.ndarray] | None, rounds: list[int]):
        self.packed, self.nodes, self.numbered, self.lists = packed, nodes, numbered, lists
        self.shape, self.k, self.sample, self.rounds = shape, k, sample, rounds

    def edges(self, least: float | None = None) -> DataFrame:
        """(src, dst, sim) between representatives: the k nearest of each, as far as they have at least this similarity."""
        spark = self.packed.sparkSession
        schema = "src long, dst long, sim float"
        if self.lists is None:
            return spark.createDataFrame([], schema)
        k, w, nb, gid = self.k, self.shape.width, self.shape.n_blocks, self.shape.gid

        def leave(block: int, kind: int, x: list) -> Iterator[Row]:
            nbrs, sims = np.frombuffer(x[1], gid).reshape(-1, w)[:, :k], np.frombuffer(x[2], np.float32).reshape(-1, w)[:, :k]
            row, at = np.nonzero((nbrs >= 0) & (sims >= (-2 if least is None else least)))
            end = nbrs[row, at]
            yield from blocks.send(LINK, end % nb, end, np.frombuffer(x[4], np.int64)[row], sims[row, at])

        return self.named(blocks.each(self.lists, leave), schema)

    def named(self, links: DataFrame, schema: str) -> DataFrame:
        """Messages LINK (node, id of the other side, similarity) as rows of ids (other side, node, similarity)."""
        nb, gid = self.shape.n_blocks, self.shape.gid
        columns = [c.split()[0] for c in schema.split(", ")]

        def name(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            inbox = Inbox(rows)
            _, ids = inbox.get(NODE, (np.int64, 0), (np.int64, 0))
            ids = np.sort(ids)  # numbers follow the ids within a block
            end, src, sims = inbox.get(LINK, (gid, 0), (np.int64, 0), (np.float32, 0))
            for at in range(0, len(end), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(src[part]), pa.array(ids[end[part] // nb]), pa.array(sims[part])], columns)

        return links.unionByName(_kind(self.numbered, NODE, "ab")).repartitionById(nb, "block").mapInArrow(name, schema)


def _kind(table: DataFrame, kind: int, columns: str = "abcde") -> DataFrame:
    """The messages of a kind, of which only some arrays are read."""
    some = [c if c in ("block", "kind", "n") or c in columns else F.lit(None).cast("binary").alias(c) for c in ["block", "kind", "n", *"abcde"]]
    return table.filter(F.col("kind") == kind).select(*some)


#: how tables of bytes that no codec makes smaller are written
PLAIN = {"compression": "none", "parquet.enable.dictionary": "false"}


def _started(numbered: DataFrame, cells: Cells, shape: Shape, longest: int) -> DataFrame:
    """The first lists: from the cells' members."""
    first = blocks.at_blocks([_cell_candidates(numbered, cells, shape, longest), _kind(numbered, NODE, "ab")], shape.n_blocks, _merged(shape, 0, True))
    return workspace.materialise(first, "lists", **PLAIN)


def _wave(numbered: DataFrame, lists: DataFrame, shape: Shape, turn: int, wave: int, waves: int) -> DataFrame:
    """The lists after the blocks of a wave have compared what meets at their nodes."""
    nb = shape.n_blocks
    met = blocks.at_blocks([blocks.each(lists, _sent_edges(shape, turn, wave, waves))], nb, _visits(shape, turn))
    met = workspace.materialise(met, "visits", **PLAIN)
    served = blocks.at_blocks([_kind(met, NEED), _kind(numbered, NODE), blocks.each(lists, _last(shape))], nb, _served(shape))
    found = blocks.at_blocks([served, _kind(met, VISIT)], nb, _compared(shape))
    merged = blocks.at_blocks([found, lists], nb, _merged(shape, turn, wave == waves - 1))
    merged = workspace.materialise(merged, "lists", **PLAIN)
    workspace.discard(lists)
    workspace.discard(met)
    return merged


def nn_descent(
    df: DataFrame,
    key: str,
    vector: str,
    dim: int = 100,
    k: int = 10,
    width: int = 20,
    sample: int = 12,
    probes: int = 4,
    cell_rows: int | None = None,
    max_cells: int = 4096,
    sample_rows: int = 8192,
    block_rows: int = 40_000,
    waves: int = 2,
    stop_share: float = 0.02,
) -> Graph:
    """Builds the graph of the k most similar vectors of every vector.  See the module's text."""
    spark = df.sparkSession
    packed = workspace.materialise(pack_vectors(df, key, vector, dim), "vectors", **PLAIN)
    # copies of a vector, and repeated ids, are represented by the smallest id
    one = packed.groupBy("copy").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    n_all, n_copies, n_ids = packed.count(), one.filter("n > 1").count(), packed.agg(F.countDistinct("id")).first()[0]
    if n_copies or n_ids < n_all:
        nodes = packed.join(one.select("copy", "id"), ["copy", "id"], "left_semi").dropDuplicates(["id"])
        nodes = workspace.materialise(nodes, "nodes", **PLAIN)
    else:
        nodes = packed
    n = nodes.count()
    if n == 0:
        return Graph(packed, nodes, None, None, None, k, None, [])
    # about the square root: then landmarks and members cost a vector alike
    cell_rows = cell_rows or min(1500, max(64, int(3.4 * math.sqrt(n))))
    n_blocks = max(1, min(6, n // 256), math.ceil(n / block_rows))
    shape = Shape(dim, n, n_blocks, width, sample)
    numbered = workspace.materialise(_numbered(nodes, dim, n_blocks), "numbered", **PLAIN)
    if nodes is packed:
        workspace.discard(packed)
        nodes = packed = _unpacked(numbered, dim)
    gids, vec = _sample(numbered, dim, n, sample_rows)
    cells = Cells(_unit(vec), n, cell_rows, probes, max_cells)
    lists = _started(numbered, cells, shape, 4 * cell_rows)
    workspace.release(spark)
    rounds: list[int] = []
    waves = min(waves, n_blocks)
    while True:
        changed = 0
        for wave in range(waves):
            lists = _wave(numbered, lists, shape, len(rounds) + 1, wave, waves)
            changed += lists.agg(F.sum("n")).first()[0] or 0
            workspace.release(spark)
        rounds.append(changed)
        if changed <= stop_share * n * width:  # lists only ever get closer, so this comes
            break
    return Graph(packed, nodes, numbered, lists, shape, k, (gids, vec), rounds)


def _sample(numbered: DataFrame, dim: int, n: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(gids, bytes) of at most ``rows`` nodes in hash order."""
    share = min(1.0, 2 * rows / n)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, v in zip(b.column(0), b.column(1), strict=True):
                gids = np.frombuffer(g.as_buffer(), np.int64)
                h = _mix(gids, 5)
                keep = h <= share * 2**32
                yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(gids[keep]), _binary(np.frombuffer(v.as_buffer(), np.int8).reshape(-1, dim)[keep])], ["h", "gid", "vec"])

    got = numbered.select("a", "c").mapInArrow(pick, "h long, gid long, vec binary").orderBy("h", "gid").limit(rows).collect()  # bounded
    return np.array([r[1] for r in got], np.int64), np.frombuffer(b"".join(bytes(r[2]) for r in got), np.int8).reshape(-1, dim)


def _members(graph: Graph, most: int) -> DataFrame:
    """(rep, id, place, n): the copies of every vector that has some, the first ``most`` by id with their place."""
    groups = graph.packed.groupBy("copy").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("n")).filter("n > 1")
    rows = graph.packed.select("copy", "id").distinct().join(groups, "copy").select("rep", "id", "n")
    w = Window.partitionBy("rep").orderBy("id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def similar_pairs(graph: Graph, source: DataFrame, key: str, vector: str, k: int, least: float, doubt: float = 0.006, broadcast_pairs: int = 200_000) -> DataFrame:
    """(a, b), a < b: pairs of a cosine of at least ``least``, one among the k most similar of the other.

    Pairs within ``doubt`` of the threshold, where the signed bytes could mislead, are measured again on the vectors
    themselves.  Copies come first in each other's lists; of many copies the smaller ids.
    """
    e = graph.edges(least - doubt)
    w = Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst")
    e = e.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    pairs = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    pairs = workspace.materialise(pairs, "pairs")
    sure = pairs.filter(F.col("sim") >= least + doubt).select("a", "b")
    near = pairs.filter(F.col("sim") < least + doubt).select("a", "b")
    x = source.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).filter("id is not null and x is not null")
    small = near.count() <= broadcast_pairs
    side = F.broadcast(near) if small else near
    with_a = x.withColumnRenamed("x", "x_a").join(side, F.col("id") == F.col("a")).select("a", "b", "x_a")
    with_a = workspace.materialise(with_a, "pairs-a")  # a few rows: the vectors of pairs near the threshold
    with_b = x.withColumnRenamed("x", "x_b").join(F.broadcast(with_a) if small else with_a, F.col("id") == F.col("b"))

    def dot(p: str, q: str) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    cosine = dot("x_a", "x_b") / F.sqrt(dot("x_a", "x_a") * dot("x_b", "x_b"))
    checked = with_b.filter(cosine >= least).select("a", "b")
    pairs = sure.unionByName(checked).distinct()
    if graph.nodes is graph.packed:
        return pairs
    return _with_copies(graph, pairs, k)


def _with_copies(graph: Graph, pairs: DataFrame, k: int) -> DataFrame:
    """Pairs of all vectors from pairs of representatives: copies are the nearest of each other."""
    groups = graph.packed.groupBy("copy").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("n"))
    every = graph.packed.select("copy", "id").distinct().join(groups, "copy").select("rep", "id", "n")
    firsts = _members(graph, k + 1).select("rep", F.col("id").alias("other"), "place")
    among = every.filter("n > 1").join(firsts, "rep").filter(F.col("id") != F.col("other"))
    # of the first k + 1 copies, k remain for each copy: the one after the k-th only serves the first k
    own = F.when(F.col("id") <= F.col("other"), F.col("place") - 1).otherwise(F.col("place"))
    among = among.filter(own <= k).select("id", "other")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = every.select(F.col("rep").alias("a"), F.col("id"), F.col("n").alias("n_a"))
    right = every.filter("n > 1").select(F.col("rep").alias("b")).distinct()
    firsts_b = firsts.select(F.col("rep").alias("b"), "other", "place").unionByName(
        both.select("b").distinct().join(right, "b", "left_anti").select("b", F.col("b").alias("other"), F.lit(1).alias("place"))
    )
    # copies of a take the first places; what is left goes to the copies of b in order of id
    across = both.join(left, "a").join(firsts_b, "b").filter(F.col("place") <= k - (F.col("n_a") - 1)).select("id", "other")
    found = among.unionByName(across)
    return found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def rows_of_copies(graph: Graph, e: DataFrame, k: int) -> DataFrame:
    """(src, dst, sim) of all vectors, at most k a source, from those of representatives; copies are the nearest of each other.

    Of many copies the smaller ids are neighbours.
    """
    if graph.nodes is graph.packed:
        return e
    groups = graph.packed.groupBy("copy").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("n"))
    every = graph.packed.select("copy", "id").distinct().join(groups, "copy").select("rep", "id", "n")
    firsts = _members(graph, k + 1).select("rep", F.col("id").alias("other"), "place")
    among = every.filter("n > 1").join(firsts, "rep").filter(F.col("id") != F.col("other"))
    own = F.when(F.col("id") <= F.col("other"), F.col("place") - 1).otherwise(F.col("place"))
    among = among.filter(own <= k).select(F.col("id").alias("src"), F.col("other").alias("dst"), F.lit(1.0).cast("float").alias("sim"))
    others = firsts.select("rep", "other").unionByName(every.filter("n = 1").select("rep", F.col("id").alias("other")))
    room = every.filter("id = rep").select(F.col("rep").alias("src"), "n")
    w = Window.partitionBy("src").orderBy(F.col("sim").desc(), "other")
    across = e.join(others.withColumnRenamed("rep", "dst"), "dst").join(room, "src").withColumn("place", F.row_number().over(w))
    across = across.filter(F.col("place") <= k - (F.col("n") - 1)).select(F.col("src").alias("rep"), F.col("other").alias("dst"), "sim")
    across = across.join(every.select("rep", F.col("id").alias("src")), "rep").select("src", "dst", "sim")
    return among.unionByName(across)

#: nodes with the ends of their edges in both directions
WAYS = 13


def _ways(graph: Graph, both: int) -> DataFrame:
    """Messages WAYS: gids, numbers of ends, the ends, bytes and inverse norms.  The ``both`` nearest count backward too."""
    shape = graph.shape
    w, nb, gid, dim = shape.width, shape.n_blocks, shape.gid, shape.dim

    def leave(block: int, kind: int, x: list) -> Iterator[Row]:
        gids, nbrs = np.frombuffer(x[0], gid), np.frombuffer(x[1], gid).reshape(-1, w)
        row, at = np.nonzero(nbrs >= 0)
        yield from blocks.send(LINK, np.full(len(row), block), gids[row], nbrs[row, at])
        back = at < both
        end = nbrs[row[back], at[back]]
        yield from blocks.send(LINK, end % nb, end, gids[row[back]])

    def gather(inbox: Inbox) -> Iterator[Row]:
        gids, _, vec, inverse = inbox.get(NODE, (np.int64, 0), (np.int64, 0), (np.int8, dim), (np.float32, 0))
        order = np.argsort(gids)
        at, end = inbox.get(LINK, (gid, 0), (gid, 0))
        key = np.unique((at // nb).astype(np.int64) << 47 | end.astype(np.int64))
        row, end = key >> 47, (key & (1 << 47) - 1).astype(gid)
        count = np.bincount(row, minlength=len(gids))
        ends = np.r_[0, np.cumsum(count)]
        for b in range(0, len(gids), 8192):
            part = order[b : b + 8192]
            yield blocks.pack(inbox.block, WAYS, 0, gids[part].astype(gid), count[b : b + 8192].astype(np.int32), end[ends[b] : ends[min(b + 8192, len(gids))]], vec[part], inverse[part])

    return blocks.at_blocks([blocks.each(graph.lists, leave), _kind(graph.numbered, NODE)], nb, gather)


def _pick(counts: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The items of some rows of a ragged table."""
    starts = np.r_[0, np.cumsum(counts)][rows]
    n = counts[rows].astype(np.int64)
    return flat[np.repeat(starts - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(rows) else flat[:0]


def greedy_search(graph: Graph, queries: DataFrame, k: int = 10, beam: int = 64, starts: int = 16, expand: int = 12, both: int | None = None, part_rows: int = 4096) -> DataFrame:
    """(query, id, sim, rank): the k most similar nodes of every query (query, vec) by greedy search on the graph.

    A query enters at the ``starts`` nearest nodes of the bounded sample.  In each step its ``expand`` best nodes that are
    not yet expanded give way to the ends of their edges; the walk ends when all ``beam`` best nodes of every query are
    expanded, so none of them changes any more.  Queries walk in parts of
    about ``part_rows``, one part after the other, so that what is on the way at a time stays bounded.
    """
    spark = queries.sparkSession
    n_queries = queries.count()
    if graph.lists is None or not n_queries:
        return spark.createDataFrame([], "query long, id long, sim float, rank int")
    ways = workspace.materialise(_ways(graph, both or graph.k), "ways", **PLAIN)
    workspace.release(spark)
    parts = -(-n_queries // part_rows)
    found = [_walk(graph, ways, queries.filter(F.pmod(F.xxhash64("query", F.lit(9)), F.lit(parts)) == i), k, beam, starts, expand) for i in range(parts)]
    workspace.discard(ways)
    return reduce(DataFrame.unionByName, found)


def _walk(graph: Graph, ways: DataFrame, queries: DataFrame, k: int, beam: int, starts: int, expand: int) -> DataFrame:
    """The search of one part of the queries, in a table of its own."""
    spark = queries.sparkSession
    n_queries = queries.count()
    shape, (sample, sample_vec) = graph.shape, graph.sample
    nb, gid, dim, beam = shape.n_blocks, shape.gid, shape.dim, max(beam, 2 * k)
    qb = max(1, min(8, n_queries // 64), math.ceil(n_queries / 4096))

    def scatter(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            yield from blocks.batches(blocks.send(RAW, _mix(ids, 3) % qb, ids, _matrix(b.column(1), dim)))

    def asks(block: int, q: np.ndarray, node: np.ndarray, vec: np.ndarray, worst: np.ndarray) -> Iterator[Row]:
        order = np.argsort(node % nb, kind="stable")
        q, node = q[order], node[order]
        owner = node % nb
        cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(owner) else np.zeros(1, int)
        for b, e in zip(cuts[:-1], cuts[1:], strict=True):
            who, at = np.unique(q[b:e], return_inverse=True)
            yield blocks.pack(int(owner[b]), ASK, block, node[b:e], at.astype(np.int32), vec[who], who.astype(np.int32), worst[who])

    def enter(inbox: Inbox) -> Iterator[Row]:
        ids, vec = inbox.get(RAW, (np.int64, 0), (np.int8, dim))
        g = _unit(vec) @ _unit(sample_vec).T
        take = min(starts, g.shape[1])
        near = np.argpartition(g, g.shape[1] - take, axis=1)[:, -take:]
        q = np.repeat(np.arange(len(ids)), take)
        yield blocks.pack(inbox.block, STATE, len(q), ids, vec, np.full((len(ids), beam), -1, gid), np.full((len(ids), beam), -2, np.float32), np.zeros((len(ids), beam), np.int8))
        yield from asks(inbox.block, q, sample[near].ravel().astype(gid), vec, np.full(len(ids), -2, np.float32))

    def answer(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in rows if b.num_rows]
        if held:
            yield from blocks.batches(answers(held))

    def answers(held: list[pa.RecordBatch]) -> Iterator[Row]:
        inbox = Inbox(iter(held))
        gids, count, flat, vec, inverse = inbox.get(WAYS, (gid, 0), (np.int32, 0), (gid, 0), (np.int8, dim), (np.float32, 0))
        order = np.argsort(gids)  # rows come in any order: place within the block -> row of the tables
        for b in held:
            for kind, to, *x in zip(*(b.column(i).to_pylist() if i < 3 else b.column(i) for i in range(1, 8)), strict=True):
                if kind != ASK:
                    continue
                node, at, who, worst = np.frombuffer(x[0].as_buffer(), gid), np.frombuffer(x[1].as_buffer(), np.int32), np.frombuffer(x[3].as_buffer(), np.int32), np.frombuffer(x[4].as_buffer(), np.float32)
                q = _unit(np.frombuffer(x[2].as_buffer(), np.int8).reshape(-1, dim))
                row = order[node // nb]
                sim = np.empty(len(node), np.float32)
                for s in range(0, len(node), 50_000):
                    part = slice(s, s + 50_000)
                    sim[part] = np.einsum("ij,ij->i", vec[row[part]].astype(np.float32), q[at[part]]) * inverse[row[part]]
                good = sim >= worst[at]
                yield blocks.pack(to, ANSWER, 0, who[at[good]], node[good], sim[good])
                seen = np.unique(row[good])
                yield blocks.pack(to, WAYS, 0, gids[seen], count[seen], _pick(count, flat, seen))

    def step(inbox: Inbox) -> Iterator[Row]:
        ids, vec, best, sims, done = inbox.get(STATE, (np.int64, 0), (np.int8, dim), (gid, beam), (np.float32, beam), (np.int8, beam))
        q, node, sim = inbox.get(ANSWER, (np.int32, 0), (gid, 0), (np.float32, 0))
        known, count, flat = inbox.get(WAYS, (gid, 0), (np.int32, 0), (gid, 0))
        has = best >= 0
        r = np.r_[np.nonzero(has)[0], q].astype(np.int64)
        n = np.r_[best[has], node].astype(np.int64)
        v, fresh, gone = np.r_[sims[has], sim], np.r_[np.zeros(has.sum(), bool), np.ones(len(q), bool)], np.r_[done[has], np.zeros(len(q), np.int8)]
        order = np.argsort((r << 46 | n) << 1 | fresh)
        r, n, v, gone = r[order], n[order], v[order], gone[order]
        first = np.r_[True, (r[1:] != r[:-1]) | (n[1:] != n[:-1])][: len(r)]
        r, n, v, gone = r[first], n[first], v[first], gone[first]
        order = np.argsort(r << 32 | ((1.001 - v.astype(np.float64)) * 2**30).astype(np.int64), kind="stable")
        r, n, v, gone = r[order], n[order], v[order], gone[order]
        place = _places(r)
        keep = place < beam
        r, n, v, gone, place = r[keep], n[keep], v[keep], gone[keep], place[keep]
        # the best open nodes: those whose edges came with the answers are expanded, the edges of others are asked for
        still = np.flatnonzero(gone == 0)
        turn = still[_places(r[still]) < expand]
        order = np.argsort(known)
        there = np.isin(n[turn], known)
        now, later = turn[there], turn[~there]
        at = order[np.searchsorted(known[order], n[now])] if len(now) else np.zeros(0, np.int64)
        gone[now] = 1
        best, sims, done = np.full((len(ids), beam), -1, gid), np.full((len(ids), beam), -2, np.float32), np.zeros((len(ids), beam), np.int8)
        best[r, place], sims[r, place], done[r, place] = n, v, gone
        asked = np.unique(np.repeat(r[now], count[at]) << 46 | _pick(count, flat, at).astype(np.int64))
        asked = asked[~np.isin(asked, r << 46 | n)]
        asked = np.r_[asked, r[later] << 46 | n[later]]
        who, node = asked >> 46, (asked & (1 << 46) - 1).astype(gid)
        yield blocks.pack(inbox.block, STATE, len(asked) + int((gone == 0).sum()), ids, vec, best, sims, done)
        yield from asks(inbox.block, who, node, vec, sims[:, -1])

    at = workspace.materialise(blocks.at_blocks([queries.select("query", "vec").mapInArrow(scatter, blocks.MESSAGE)], qb, enter), "walk", **PLAIN)
    def walked(at: DataFrame) -> DataFrame:
        answered = _kind(at, ASK).unionByName(ways).repartitionById(nb, "block").mapInArrow(answer, blocks.MESSAGE)
        return workspace.materialise(blocks.at_blocks([answered, _kind(at, STATE)], qb, step), "walk", **PLAIN)

    while (at.filter(F.col("kind") == STATE).agg(F.sum("n")).first()[0] or 0) > 0:
        last, at = at, walked(at)
        workspace.discard(last)
        workspace.release(spark)

    def leave(block: int, kind: int, x: list) -> Iterator[Row]:
        best, sims = np.frombuffer(x[2], gid).reshape(-1, beam)[:, : 2 * k], np.frombuffer(x[3], np.float32).reshape(-1, beam)[:, : 2 * k]
        row, place = np.nonzero(best >= 0)
        end = best[row, place]
        yield from blocks.send(LINK, end % nb, end, np.frombuffer(x[0], np.int64)[row], sims[row, place])

    found = graph.named(blocks.each(_kind(at, STATE), leave), "query long, id long, sim float")
    keep = Window.partitionBy("query").orderBy(F.col("sim").desc(), "id")
    found = workspace.materialise(found.withColumn("rank", F.row_number().over(keep)).filter(F.col("rank") <= k), "found")
    workspace.discard(at)
    return found
