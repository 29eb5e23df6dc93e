"""Per-document text quality statistics, from associative partial counts of chunks.

A document is cut into chunks of about ``CHUNK`` characters, after a letter or digit and before white space where there
is such a place, else between two of them, and never within markup, so no mark is cut from what it ends.  The partial
counts of a chunk are a monoid: sums over its whole units, and as boundary state the unfinished unit, word and token at
either edge.  Joining two neighbours finishes what they share.  Whether a number begins a line of a list depends on the
lines around it, so a chunk brings along what it has to know of the lines that lie across its edges (``Around``).  Chunks
of long documents are spread over tasks and merged in a tree of fan-out ``FAN``; a document of one chunk needs no shuffle.

A unit is a stretch of text that ends with sentence marks before white space or at a blank line.  It counts as running
prose if it ends with a sentence mark, holds no dot leaders, has few symbols that prose does not use, and its tokens are
not mostly crumbs; in scripts without sentence marks, long stretches between white space count.  ``prose_share`` is the
share of the characters, without white space, in such units.

The counts of merged chunks are those of the whole document, whatever the size of a chunk.

Defined cases: null texts give no row; a text without characters has counts of 0, null means and shares, and no rule
fails; repeated ids are documents of their own; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 16_384
FAN = 64

# fixed values: frequent function words of the languages of these texts
COMMON = frozenset(
    (
        "the of and to in is that for it as was with be by on not are or an at from this have been which "
        "der die das und ist von zu den mit für im auf nicht eine wird muss "
        "le la les des et est une du dans pour que qui sur par doit "
        "el los las de del en un una por con se su no será "
        "o a os as do da em um uma não com deve que "
        "и в на не по с что из для от за до"
    ).split()
)
_MARKS = ".!?…。！？｡．؟।॥"
_WIDE = frozenset("。！？｡．।॥")
_END = re.compile(r"[.!?…。！？｡．؟।॥]+[\"”»“’)\]）」』]*(?:\s?»)?(?:\s*</?\w[^<>]{0,80}>)*(?=(\s*)(\S?))|\n\s*\n")
_NOISE = str.maketrans("", "", "|~`^_{}\\=#*@│├┤─┼")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\[\]«»“”„’‘—–\-…。、，！？：；（）「」『』؟،؛।]")
_MARKLESS = re.compile(r"[฀-๿຀-໿က-႟ក-៿]")
_LINE_END = re.compile(r"[.!?…。！？｡．؟।॥:;][\"”»“’)\]）」』]*[^\S\n]*(?:\n|\Z)")

_NUMBER = re.compile(r"\s*\d{1,3}\. ")


class Around(NamedTuple):
    """What a chunk has to know of the lines that lie across its edges."""

    #: digits that the line at the chunk's begin starts with before it ("0" for any), "x" if there is something else
    before: str = ""
    #: whether that line is the document's first
    first: bool = True
    #: whether the line before it, that line itself, and the line after the chunk's last begin with a number
    last_numbered: bool = False
    numbered: bool = False
    next_numbered: bool = False
    #: the characters behind the chunk that a number at its end may go on with
    ahead: str = ""


def _listed(text: str, line: int, end: int, around: Around) -> bool:
    """Whether the line before or after a line that begins with a number begins with one too, or the text begins here."""
    if not line:
        if around.first:
            return True
        before = around.last_numbered
    else:
        at = text.rfind("\n", 0, line - 1) + 1
        before = bool(_NUMBER.match(text, at)) if at else around.numbered
    if before:
        return True
    after = text.find("\n", end) + 1
    if not after:
        return around.next_numbered
    return bool(_NUMBER.match(text, after)) or bool(around.ahead and text[-1].isdigit() and text[after:].strip().isdigit() and _NUMBER.match(text[after:] + around.ahead))


#: columns of a partial: sums, then the two edges
SUMS = ["chars", "spaces", "words", "common", "symbols", "lines", "lines_punct", "prose", "units"]
EDGE = ["chars", "tokens", "noise", "leaders", "markless"]
#: the tokens at the edges that may go on: their lengths and letters of scripts without marks
OPEN = ["h_len", "h_n", "t_len", "t_n"]
_LONGS = [*SUMS, "cut", *[f"h_{c}" for c in EDGE], "h_term", *[f"t_{c}" for c in EDGE], *OPEN]
COLUMNS = [*_LONGS, "first", "last"]
SCHEMA = ", ".join(f"{c} long" for c in _LONGS) + ", first string, last string"
#: stands for any word too long to be a common one
_LONG_WORD = "-" * 17


def cut_points(text: str, size: int = CHUNK) -> list[int]:
    """Where a text is cut: before white space that follows a letter or digit, else between two of them."""

    def safe(i: int, space: bool) -> bool:
        if not text[i - 1].isalnum() or not (text[i].isspace() if space else text[i].isalnum()):
            return False
        return text.rfind("<", max(0, i - 100), i) <= text.rfind(">", max(0, i - 100), i)  # not within markup

    cuts, at = [0], 0
    while len(text) - at > size:
        end = at + size
        back = range(end, max(at + size // 2, end - 2048), -1)
        k = next((i for i in back if safe(i, True)), 0) or next((i for i in back if safe(i, False)), 0)
        k = k or next((i for i in range(end + 1, len(text)) if safe(i, True) or safe(i, False)), 0)
        if not k:
            break
        cuts.append(k)
        at = k
    return [*cuts, len(text)]


def chunks(text: str, size: int = CHUNK) -> list[tuple[str, Around]]:
    """The chunks of a text with what each has to know of the lines around it."""
    cuts = cut_points(text, size)
    spans = list(zip(cuts, cuts[1:], strict=False))
    following = [0] * len(spans)  # where the line after the chunk's last one begins, 0: nowhere
    nxt = 0
    for i in range(len(spans) - 1, -1, -1):
        following[i] = nxt
        nxt = text.find("\n", *spans[i]) + 1 or nxt
    out, line, last = [], 0, -1
    for (b, e), after in zip(spans, following, strict=True):
        newest = text.rfind("\n", line, b) + 1
        if newest > line:
            line = newest
            last = text.rfind("\n", 0, line - 1) + 1
        head = text[line : min(b, line + 200)].strip() if b - line <= 200 else "x"
        if b - line > 200 and not text[line:b].strip():
            head = ""
        before = "" if not head else "0" if head.isdigit() else "x"
        number = [bool(_NUMBER.match(text, x)) for x in (last, line, after)] if last >= 0 else [False, bool(_NUMBER.match(text, line)), bool(_NUMBER.match(text, after))]
        out.append((text[b:e], Around(before, line == 0, number[0], number[1], after > 0 and number[2], text[e : e + 5])))
    return out


def _judged(length: int, markless: int) -> int:
    return length if markless >= 20 and 2 * markless > length else 0


def _features(unit: str, open_left: bool = False, open_right: bool = False) -> tuple[list[int], tuple[int, int], tuple[int, int]]:
    """The features of a unit; tokens at open edges are not yet judged, but returned as (length, markless letters)."""
    tokens = unit.split()
    chars = sum(map(len, tokens))
    noise = len(unit) - len(unit.translate(_NOISE))
    markless, left, right = 0, (0, 0), (0, 0)
    if tokens and (open_left or open_right):
        left, right = ((len(t), len(_MARKLESS.findall(t))) if o else (0, 0) for t, o in ((tokens[0], open_left), (tokens[-1], open_right)))
    if _MARKLESS.search(unit):
        markless = sum(_judged(len(t), len(_MARKLESS.findall(t))) for t in tokens[int(left[0] > 0) : len(tokens) - int(right[0] > 0)])
    return [chars, len(tokens), noise, unit.count("...."), markless], left, right


def _prose(f: list[int], term: bool) -> int:
    chars, tokens, noise, leaders, markless = f
    if term and chars >= 2 and not leaders and noise <= 0.02 * chars and not (tokens >= 4 and chars < 2.3 * tokens):
        return chars
    return markless


def partial(text: str, first: bool = True, around: Around | None = None) -> list:
    """The partial counts of a chunk, in the order of COLUMNS; first: whether it begins its document."""
    around = around or Around(first=first)
    words = text.lower().split()
    chars = sum(map(len, words))
    # the words at the edges may go on in the next chunk: they are kept as state and not yet judged
    open_left = bool(words) and not text[0].isspace()
    open_right = bool(words) and not text[-1].isspace()
    head_word = words[0] if open_left else ""
    tail_word = words[-1] if open_right else ""
    common = sum(map(COMMON.__contains__, words))
    if open_left and head_word in COMMON:
        common -= 1
    if open_right and tail_word in COMMON and not (open_left and len(words) == 1):
        common -= 1
    line_ends = text.count("\n")
    punct = sum(1 for m in _LINE_END.finditer(text) if text[m.end() - 1] == "\n")
    sums = [chars, len(text) - chars, len(words), common, len(_SYMBOL.findall(text)), line_ends, punct, 0, 0]
    head: list[int] | None = None
    head_term, at, prose, units = 0, 0, 0, 0
    left = (0, 0)
    for m in _END.finditer(text):
        mark = text[m.start()]
        term = mark != "\n"
        if term:
            run = m.group()
            if "...." in run:
                continue
            if not (mark in _WIDE or any(c in _WIDE for c in run)):
                space, nxt = m.group(1), m.group(2)
                if nxt and (not space or nxt.islower()):
                    continue
                if mark == "." and nxt and m.start() and text[m.start() - 1].isdigit():
                    line = text.rfind("\n", 0, m.start()) + 1
                    number = text[line : m.start()].strip() if line else around.before + text[: m.start()].strip()
                    if number.isdigit() and _listed(text, line, m.end(), around):
                        continue  # the number of a list item
        if head is None:
            head, left, _ = _features(text[at : m.end()], open_left=open_left)
            head_term = int(term)
        else:
            prose += _prose(_features(text[at : m.end()])[0], term)
            units += 1
        at = m.end()
    rest, rest_left, right = _features(text[at:], open_left and head is None, open_right)
    sums[7], sums[8] = prose, units
    none = [0] * len(EDGE)
    edges = [_short(head_word), _short(tail_word)]
    if head is None:
        return [*sums, 0, *rest, 0, *none, *rest_left, *right, *edges]
    return [*sums, 1, *head, head_term, *rest, *left, *right, *edges]


def _short(word: str) -> str:
    return word if len(word) < len(_LONG_WORD) else _LONG_WORD


_S, _E = len(SUMS), len(EDGE)
_HEAD, _TERM, _TAIL, _OPEN = slice(_S + 1, _S + 1 + _E), _S + 1 + _E, slice(_S + 2 + _E, _S + 2 + 2 * _E), slice(_S + 2 + 2 * _E, _S + 6 + 2 * _E)


def _one_token(p: list) -> bool:
    """Whether a partial is a single token that is open on both sides."""
    h_len, _, t_len, _ = p[_OPEN]
    return not p[_S] and p[_HEAD][1] == 1 and h_len > 0 and t_len > 0


def merge(a: list, b: list) -> list:
    """The partial of two neighbouring chunks."""
    sums = [x + y for x, y in zip(a[:_S], b[:_S], strict=True)]
    a_cut, b_cut = a[_S], b[_S]
    a_head, a_term, b_tail = a[_HEAD], a[_TERM], b[_TAIL]
    b_head, b_term = b[_HEAD], b[_TERM]
    a_first, a_last, b_first, b_last = a[-2], a[-1], b[-2], b[-1]
    joined = [x + y for x, y in zip(a[_TAIL] if a_cut else a_head, b_head, strict=True)]
    first, last = a_first, b_last
    a_left, a_right, b_left, b_right = (tuple(p[_OPEN][i : i + 2]) for p in (a, b) for i in (0, 2))
    left, right = a_left, b_right
    a_one, b_one = _one_token(a), _one_token(b)
    if a_last and b_first:  # one word lies across the cut
        sums[2] -= 1
        joined[1] -= 1
        token = (a_right[0] + b_left[0], a_right[1] + b_left[1])
        if a_one:
            left = token
        if b_one:
            right = token
        if not a_one and not b_one:
            joined[4] += _judged(*token)
        word = _short(a_last + b_first)
        a_whole, b_whole = a[2] == 1 and bool(a_first), b[2] == 1 and bool(b_last)
        if a_whole:
            first = word
        if b_whole:
            last = word
        if not a_whole and not b_whole:
            sums[3] += word in COMMON
    else:
        if not a_one:
            joined[4] += _judged(*a_right)
        if not b_one:
            joined[4] += _judged(*b_left)
        if a_last and not (a[2] == 1 and a_first):
            sums[3] += a_last in COMMON
        if b_first and not (b[2] == 1 and b_last):
            sums[3] += b_first in COMMON
    none = [0] * _E
    edges = [*left, *right, first, last]
    if not a_cut and not b_cut:
        return [*sums, 0, *joined, 0, *none, *edges]
    if not a_cut:
        return [*sums, 1, *joined, b_term, *b_tail, *edges]
    if not b_cut:
        return [*sums, 1, *a_head, a_term, *joined, *edges]
    sums[7] += _prose(joined, bool(b_term))
    sums[8] += 1
    return [*sums, 1, *a_head, a_term, *b_tail, *edges]


def finish(p: list) -> tuple:
    """(n_chars, n_words, common, symbols, n_lines, punct_lines, prose, units) of a whole document's partial."""
    chars, spaces, words, common, symbols, lines, punct, prose, units = p[:_S]
    head, term, tail = list(p[_HEAD]), p[_TERM], list(p[_TAIL])
    h_len, h_n, t_len, t_n = p[_OPEN]
    first, last = p[-2], p[-1]
    head[4] += _judged(h_len, h_n)
    if not _one_token(p):
        (tail if p[_S] else head)[4] += _judged(t_len, t_n)
    prose += _prose(head, bool(term)) + (_prose(tail, False) if p[_S] else 0)
    common += first in COMMON
    if last and not (words == 1 and first):
        common += last in COMMON
    return chars + spaces, chars, words, common, symbols, lines, punct, prose, units + 1 + p[_S]


def _partials(docs: DataFrame) -> DataFrame:
    """Partials of rows (key, idx, n, text), a row per chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            arounds = zip(*(pdf[c] for c in Around._fields), strict=True)
            rows = [[k, i, n, *partial(t, i == 0, Around(*x))] for k, i, n, t, x in zip(pdf["key"], pdf["idx"], pdf["n"], pdf["text"], arounds, strict=True)]
            yield pd.DataFrame(rows, columns=["key", "idx", "n", *COLUMNS])

    return docs.mapInPandas(run, f"key string, idx long, n long, {SCHEMA}")


def _cut(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                rows = chunks(text, size)
                yield pd.DataFrame([(key, i, len(rows), part, *x) for i, (part, x) in enumerate(rows)], columns=["key", "idx", "n", "text", *Around._fields])

    around = "before string, first boolean, last_numbered boolean, numbered boolean, next_numbered boolean, ahead string"
    return docs.mapInPandas(run, f"key string, idx long, n long, text string, {around}")


def _merge_level(partials: DataFrame, fan: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        rows = pdf[COLUMNS].values.tolist()
        total = rows[0]
        for r in rows[1:]:
            total = merge(total, r)
        return pd.DataFrame([[pdf["key"].iloc[0], int(pdf["idx"].iloc[0]) // fan, int(pdf["n"].iloc[0]), *total]], columns=["key", "idx", "n", *COLUMNS])

    up = F.floor(F.col("idx") / fan)
    return partials.groupBy("key", up.alias("up")).applyInPandas(run, f"key string, idx long, n long, {SCHEMA}")


STATS = "doc_id long, n_chars long, n_visible long, n_words long, n_common long, n_symbols long, n_lines long, n_punct_lines long, n_prose long, n_units long"


def _finished(partials: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STATS.split(", ")]
        for pdf in batches:
            rows = [(int(k.partition(":")[0]), *finish(p)) for k, p in zip(pdf["key"], pdf[COLUMNS].values.tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=names)

    return partials.mapInPandas(run, STATS)


def _whole(docs: DataFrame) -> DataFrame:
    """Statistics of documents of one chunk, without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STATS.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([(k, *finish(partial(t))) for k, t in zip(pdf["doc_id"], pdf["text"], strict=True)], columns=names)

    return docs.mapInPandas(run, STATS)


def counts(docs: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """The counts of every document (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    size = F.length("text")
    short = _whole(docs.filter(size <= chunk))
    longest = docs.agg(F.max(size)).first()[0] or 0
    if longest <= chunk:
        return short
    # repeated ids stay documents of their own: the key has a number of the row's own
    keyed = docs.filter(size > chunk).select(F.concat_ws(":", F.col("doc_id").cast("string"), F.monotonically_increasing_id().cast("string")).alias("key"), "text")
    parts = _partials(_cut(keyed, chunk).repartition("key", "idx"))
    n = -(-longest // (chunk // 2))
    while n > 1:
        parts = _merge_level(parts, fan)
        n = -(-n // fan)
    return short.unionByName(_finished(parts))


def quality(docs: DataFrame) -> DataFrame:
    """Statistics, and the outcome of each rule (true: the document fails it), of every document (doc_id, text)."""
    c = counts(docs)

    def ratio(a: str, b: str) -> Column:
        return F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)

    stats = c.select(
        "doc_id",
        "n_chars",
        "n_words",
        ratio("n_visible", "n_words").alias("mean_word_length"),
        ratio("n_symbols", "n_visible").alias("symbol_ratio"),
        F.round(F.col("n_punct_lines") / F.nullif(F.col("n_lines"), F.lit(0)), 6).alias("punct_line_share"),
        ratio("n_common", "n_words").alias("common_word_share"),
        ratio("n_prose", "n_visible").alias("prose_share"),
    )
    false = F.lit(False)
    return stats.withColumns(
        {
            "fails_length": F.col("n_words") < 3,
            "fails_word_length": F.coalesce(F.col("mean_word_length") < 2.8, false),
            "fails_symbols": F.coalesce(F.col("symbol_ratio") > 0.1, false),
            "not_prose": F.coalesce(F.col("prose_share") < 0.5, false),
        }
    )
