"""Messages between blocks of nodes: rows of few large binary columns that Spark's exchanges bring to a block's task.

A graph algorithm of many small items per node would spend its time on rows.  Here the nodes are hashed to blocks, a
task holds a block, and what it sends to another block travels as one row of packed arrays per few thousand items.
``repartitionById`` puts all rows for a block into the partition of its number, so a union of tables followed by that
exchange is a join of all of them by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: a message: for which block, of what kind, a count for statistics, and up to five packed arrays
MESSAGE = "block int, kind int, n long, a binary, b binary, c binary, d binary, e binary"
#: items of a row at most, and bytes of an Arrow batch about
ROW_ITEMS, BATCH_BYTES = 1 << 16, 8 << 20
Row = tuple


def pack(block: int, kind: int, n: int, *arrays: np.ndarray) -> Row:
    return (block, kind, n, *[np.ascontiguousarray(x).tobytes() for x in arrays], *[None] * (5 - len(arrays)))


def send(kind: int, owner: np.ndarray, *arrays: np.ndarray, items: int = ROW_ITEMS) -> Iterator[Row]:
    """Messages that bring each item to the block that owns it."""
    order = np.argsort(owner, kind="stable")
    owner, arrays = owner[order], tuple(x[order] for x in arrays)
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(owner) else np.zeros(1, int)
    for b, e in zip(cuts[:-1], cuts[1:], strict=True):
        for at in range(b, e, items):
            yield pack(int(owner[b]), kind, 0, *[x[at : min(e, at + items)] for x in arrays])


def batches(rows: Iterable[Row]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of messages, each of a bounded size."""
    held: list[Row] = []
    size = 0

    def flush() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "kind", "n", *"abcde"])

    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r[3:] if x is not None)
        if size > BATCH_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


class Inbox:
    """All messages of a block, by kind."""

    def __init__(self, rows: Iterator[pa.RecordBatch]):
        self.block = -1
        self.parts: dict[int, list[tuple[bytes, ...]]] = {}
        for b in rows:
            columns = [b.column(i) for i in range(3, 8)]
            for i, (block, kind) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                self.block = block
                self.parts.setdefault(kind, []).append(tuple(None if not c[i].is_valid else c[i].as_buffer() for c in columns))

    def get(self, kind: int, *types: tuple) -> list[np.ndarray]:
        """The arrays of a kind, all its messages together; a type is (dtype, width) with width 0 for flat arrays."""
        out = []
        for k, (dtype, width) in enumerate(types):
            parts = [np.frombuffer(p[k], dtype) for p in self.parts.get(kind, [])]
            flat = np.concatenate(parts) if parts else np.zeros(0, dtype)
            out.append(flat.reshape(-1, width) if width else flat)
        return out


def at_blocks(tables: list[DataFrame], n_blocks: int, f: Callable[[Inbox], Iterable[Row]]) -> DataFrame:
    """Brings the messages of all tables to their blocks and runs f on each block's."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inbox = Inbox(rows)
        if inbox.block >= 0:
            yield from batches(f(inbox))

    return reduce(DataFrame.unionByName, tables).repartitionById(n_blocks, "block").mapInArrow(run, MESSAGE)


def each(table: DataFrame, f: Callable[[int, int, list], Iterable[Row]]) -> DataFrame:
    """Runs f(block, kind, buffers) on every message where it lies, without an exchange."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[Row]:
            for b in rows:
                columns = [b.column(i) for i in range(3, 8)]
                for i, (block, kind) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                    yield from f(block, kind, [None if not c[i].is_valid else c[i].as_buffer() for c in columns])

        yield from batches(out())

    return table.mapInArrow(run, MESSAGE)
