"""Binary trees written as nested brackets, and merge histories; plain functions for use inside grouped tasks."""

from __future__ import annotations

Tree = object  # a word, or a pair of trees


def parse_tree(text: str) -> Tree:
    """'(a (b c))' as ('a', ('b', 'c')).  A node of one child is that child; more than two children lean left."""
    stack: list[list[Tree]] = [[]]
    for tok in text.replace("(", " ( ").replace(")", " ) ").split():
        if tok == "(":
            stack.append([])
        elif tok == ")":
            if len(stack) == 1:
                raise ValueError("a closing bracket too many")
            stack[-2].append(_fold(stack.pop()))
        else:
            stack[-1].append(tok)
    if len(stack) != 1 or not stack[0]:
        raise ValueError("brackets do not match")
    return _fold(stack[0])


def _fold(children: list[Tree]) -> Tree:
    node = children[0]
    for c in children[1:]:
        node = (node, c)
    return node


def show(tree: Tree) -> str:
    """Text of a tree: pairs in brackets."""
    out: list[str] = []
    stack: list[object] = [tree]
    while stack:  # trees may be deeper than calls can be
        x = stack.pop()
        if isinstance(x, tuple):
            stack += [_Text(")"), x[1], _Text(" "), x[0], _Text("(")]
        else:
            out.append(str(x))
    return "".join(out)


class _Text(str):
    """A piece of the text between nodes."""


def leaves(tree: Tree) -> list[str]:
    return leaves(tree[0]) + leaves(tree[1]) if isinstance(tree, tuple) else [str(tree)]


def height(tree: Tree) -> int:
    return 1 + max(height(tree[0]), height(tree[1])) if isinstance(tree, tuple) else 0


def spans(tree: Tree) -> list[tuple[int, int]]:
    """(first, last) leaf of every inner node, in post-order."""
    out: list[tuple[int, int]] = []

    def walk(t: Tree, at: int) -> int:
        if not isinstance(t, tuple):
            return at
        end = walk(t[1], walk(t[0], at) + 1)
        out.append((at, end))
        return end

    walk(tree, 0)
    return out


def span_keys(tree: Tree) -> list[int]:
    """first * n + last of every span, n leaves."""
    n = len(leaves(tree))
    return [a * n + b for a, b in spans(tree)]


def span_difference(a: Tree, b: Tree) -> int:
    """Spans of a that b lacks."""
    return len(set(span_keys(a)) - set(span_keys(b)))


def agreement(a: Tree, b: Tree) -> float:
    """Share of a's spans that b has."""
    n = len(spans(a))
    return (n - span_difference(a, b)) / n if n else 1.0


def merge_by_history(words: list[str], history: list[int]) -> Tree:
    """Merges neighbours k and k + 1 in the order of a history of positions; a history may be longer than needed."""
    nodes: list[Tree] = list(words)
    for k in history:
        if len(nodes) < 2:
            break
        if k < len(nodes) - 1:
            nodes[k : k + 2] = [(nodes[k], nodes[k + 1])]
    return _fold(nodes)


def binarise(tree: object) -> Tree | None:
    """A treebank tree [label, child, ...] with strings as leaves: empty elements and their nodes dropped, single children
    collapsed, the rest paired from the left."""
    if isinstance(tree, str):
        return tree
    label, *children = tree
    if label == "-NONE-":
        return None
    kept = [b for b in (binarise(c) for c in children) if b is not None]
    return _fold(kept) if kept else None


def read_treebank(text: str) -> list:
    """'(S (NP (DT a)) ...)' as nested lists."""
    stack: list[list] = [[]]
    for tok in text.replace("(", " ( ").replace(")", " ) ").split():
        if tok == "(":
            stack.append([])
        elif tok == ")":
            done = stack.pop()
            if done and not isinstance(done[0], str):
                done = ["", *done]
            stack[-1].append(done)
        else:
            stack[-1].append(tok)
    return stack[0][0]
