"""Deeply nested records as flat tables linked by interval labels.

Every node of a record's tree - each object, array and value - gets a pre-order and a post-order number by one depth-first
traversal.  Node B lies below node A of the same record exactly if ``A.pre < B.pre`` and ``B.post < A.post``, so tables of
different kinds need no chain of foreign keys.  Nodes of one kind do not contain each other, so the ancestor of a kind is
the last node of that kind before, in pre-order, if it contains the node: ``link`` finds it in one pass over the sorted
nodes of a record, and no pair is formed that is no link.  A record is parsed and labelled where it is read; labelling
shuffles nothing.

Rows come out for these kinds.  Kinds and where they are looked for (a container may be an object or an array, of elements or of arrays of elements,
because the shape of optional fields varies by record):

=========  ==============================================
label      ``labels``; an element may be a plain string
alias      ``aliases``
claim      ``claims``
qualifier  ``qualifiers`` of a claim
reference  ``references`` of a claim
refsnak    ``snaks`` of a reference
=========  ==============================================

and, if asked for, ``node`` for every other node.

Defined cases: null or blank lines, list brackets, lines that are cut off and lines whose value is no object give no rows;
nulls are no nodes; empty containers have no elements; of a key that occurs twice in an object the last value counts; a
line that is sent twice gives rows under each number; further columns are ignored; very long lines are parsed whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODES = "line_no long, kind string, node_path string, pre int, post int, parent_pre int, depth int, name string, value string"
#: field that holds the elements of a kind -> the kind, by the kind that contains it
CHILDREN = {
    "record": {"labels": "label", "aliases": "alias", "claims": "claim"},
    "claim": {"qualifiers": "qualifier", "references": "reference"},
    "reference": {"snaks": "refsnak"},
}
#: kinds whose field is one object per element when it has these keys, not a container of elements
_ELEMENT_KEYS = {
    "label": ("value", "language"),
    "alias": ("value", "language"),
    "claim": ("mainsnak",),
    "qualifier": ("snaktype", "property"),
    "reference": ("snaks",),
    "refsnak": ("snaktype", "property"),
}


def parse_line(line: str | None) -> dict[str, Any] | None:
    """The object on a line of a JSON list, or None if the line is not one whole object."""
    if line is None:
        return None
    text = line.strip(" \t\r\n,[]\ufeff")
    if not (text.startswith("{") and text.endswith("}")):
        return None
    try:
        record = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def _is_element(kind: str, x: Any) -> bool:
    return isinstance(x, dict) and any(k in x and not isinstance(x[k], list) for k in _ELEMENT_KEYS[kind])


def _elements(kind: str, container: Any, path: str) -> Iterator[tuple[str, Any]]:
    """(path, element) of a container: an object or array of elements, or of arrays or objects of them."""
    if isinstance(container, dict):
        if _is_element(kind, container) and "/" in path:
            yield path, container
            return
        items = [(f"{path}/{k}", v) for k, v in container.items()]
    elif isinstance(container, list):
        items = [(f"{path}/{i}", v) for i, v in enumerate(container)]
    else:
        return
    for at, x in items:
        if x is None:
            continue
        if isinstance(x, list):
            for i, y in enumerate(x):
                if y is not None and not isinstance(y, list):
                    yield f"{at}/{i}", y
        elif isinstance(x, dict) and kind in ("claim", "qualifier", "refsnak") and isinstance(container, dict) and not _is_element(kind, x):
            yield from _elements(kind, x, at)
        else:
            yield at, x


#: what has rows unless told otherwise
KINDS = ("label", "alias", "claim", "qualifier", "reference", "refsnak")


def _row(kind: str, node: Any, path: str) -> tuple[str | None, str | None]:
    """(name, value) of a node."""
    snak = node.get("mainsnak", node) if isinstance(node, dict) else None
    if kind == "node":
        name, value = path.rpartition("/")[2], None if isinstance(node, (dict, list)) else node
    elif kind in ("label", "alias"):
        name = node.get("language") if isinstance(node, dict) else path.split("/")[1]
        value = node.get("value") if isinstance(node, dict) else node
    elif kind == "reference":
        name, value = None, node.get("hash") if isinstance(node, dict) else None
    else:
        name = snak.get("property") if isinstance(snak, dict) else None
        value = snak.get("datavalue") if isinstance(snak, dict) else node
    plain = value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)
    return name if name is None else str(name), plain


def label_nodes(record: dict[str, Any], kinds: tuple[str, ...] = KINDS) -> list[tuple]:
    """(kind, node_path, pre, post, parent_pre, depth, name, value) of the nodes of some kinds, in pre-order.

    Numbers and depths count all nodes; ``parent_pre`` is the number of the node right above.
    """
    of_path: dict[str, str] = {}

    def find(kind: str, node: Any, path: str) -> None:
        if isinstance(node, dict):
            for field, child_kind in CHILDREN.get(kind, {}).items():
                for at, child in _elements(child_kind, node.get(field), f"{path}/{field}" if path else field):
                    of_path[at] = child_kind
                    find(child_kind, child, at)

    find("record", record, "")
    rows: list[list] = []
    pre = post = 0
    every = "node" in kinds
    # a stack in place of recursion: (node, path, parent's number, depth, row or -1, whether its children are done)
    stack: list[tuple[Any, str, int, int, int, bool]] = [(record, "", -1, 0, -1, False)]
    while stack:
        node, path, parent, depth, row, done = stack.pop()
        if done:
            if row >= 0:
                rows[row][3] = post
            post += 1
            continue
        mine = pre
        pre += 1
        kind = of_path.get(path, "node")
        if path and (kind in kinds if kind != "node" else every):
            row = len(rows)
            rows.append([kind, path, mine, 0, parent, depth, *_row(kind, node, path)])
        stack.append((node, path, parent, depth, row, True))
        items = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
        below = [(x, f"{path}/{k}" if path else str(k), mine, depth + 1, -1, False) for k, x in items if x is not None]
        stack.extend(reversed(below))
    return [tuple(r) for r in rows]


def nodes(df: DataFrame, key: str = "line_no", line: str = "raw_line", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """One row per node of the kinds of every record, with its interval labels."""

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["line_no", "kind", "node_path", "pre", "post", "parent_pre", "depth", "name", "value"]
        for pdf in batches:
            out: list[tuple] = []
            for k, text in zip(pdf["k"], pdf["line"], strict=True):
                record = parse_line(text)
                if record is not None:
                    out.extend((k, *row) for row in label_nodes(record, kinds))
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    return df.select(F.col(key).cast("long").alias("k"), F.col(line).alias("line")).filter("line is not null and k is not null").mapInPandas(label, NODES)


def kind_table(labelled: DataFrame, kind: str) -> DataFrame:
    """The flat table of one kind."""
    return labelled.filter(F.col("kind") == kind).drop("kind")


def linked(labelled: DataFrame, ancestor: str, kind: str, prefix: str) -> DataFrame:
    """The rows of a kind with the path and number of the node of the ancestor's kind that contains them; rows that none
    contains are left out.  One shuffle by record and one sort, in which each node looks at the last ancestor before it."""
    in_order = Window.partitionBy("line_no").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    above = F.when(F.col("kind") == ancestor, F.struct(F.col("post").alias("a_post"), F.col("pre").alias("a_pre"), F.col("node_path").alias("a_path")))
    rows = labelled.filter(F.col("kind").isin(ancestor, kind)).withColumn("_tx_a", F.last(above, ignorenulls=True).over(in_order))
    inside = (F.col("kind") == kind) & (F.col("_tx_a.a_pre") < F.col("pre")) & (F.col("post") < F.col("_tx_a.a_post"))
    return rows.filter(inside).select("*", F.col("_tx_a.a_pre").alias(f"{prefix}_pre"), F.col("_tx_a.a_path").alias(f"{prefix}_path")).drop("_tx_a")


def link(ancestors: DataFrame, descendants: DataFrame, prefix: str) -> DataFrame:
    """``linked`` for two tables of kinds."""
    both = ancestors.withColumn("kind", F.lit("above")).unionByName(descendants.withColumn("kind", F.lit("below")))
    return linked(both, "above", "below", prefix).drop("kind")
