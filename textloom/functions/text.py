"""Scalar functions on strings and word lists, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "-UNKNOWN-"
#: seed of the word identifiers
UID_SEED = 113377
#: words that acronyms skip
ACRONYM_SKIP = ("and", "the", "of")
NOUNS = ("NN", "NNS", "NNP", "NNPS")


def split_any(s: Column, delimiters: str = " \t") -> Column:
    """Split at each single delimiter; empty parts stay."""
    return F.split(s, "[" + delimiters.replace("\t", "\\t") + "]", -1)


def words(s: Column) -> Column:
    """White-space tokens, no empty ones."""
    return F.array_remove(F.split(s, "\\s+"), "")


def strip(s: Column) -> Column:
    return F.regexp_replace(s, "^\\s+|\\s+$", "")


def is_blank(s: Column) -> Column:
    return ~s.rlike("\\S")


def code_points(s: Column, beg: Column | int, end: Column | int) -> Column:
    """Substring by code points, begin inclusive, end exclusive."""
    b = F.lit(beg) if isinstance(beg, int) else beg
    e = F.lit(end) if isinstance(end, int) else end
    return F.substring(s, b + 1, e - b)


def sentences(s: Column) -> Column:
    """Plain sentences: lines, cut after . ! ? before blanks; no blank ones."""
    cut = F.flatten(F.transform(F.split(s, "\n"), lambda x: F.split(x, "(?<=[.!?]) +")))
    return F.filter(cut, lambda x: x.rlike("\\S"))


def pack_words(ws: Column) -> Column:
    """A word list as one string with NUL between words."""
    return F.array_join(ws, "\x00")


def unpack_words(s: Column) -> Column:
    return F.split(s, "\x00")


def ngrams(ws: Column, n: int) -> Column:
    """Joined runs of n words; fewer than n words give none.

    The word list is zipped with itself, shifted, so the work is linear in its length.
    """
    count = F.greatest(F.size(ws) - (n - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice(ws, i + 1, count).alias(f"w{i}") for i in range(n)])
    return F.transform(shifted, lambda z: F.concat_ws(" ", *[z[f"w{i}"] for i in range(n)]))


def acronym(ws: Column) -> Column:
    """First letters in capitals, without the skipped words and words that begin with no letter."""
    kept = F.filter(ws, lambda w: w.rlike("^[A-Za-z]") & ~w.isin(*ACRONYM_SKIP))
    return F.array_join(F.transform(kept, lambda w: F.upper(F.substring(w, 1, 1))), "")


def letter_words(s: Column) -> Column:
    """Lower-cased tokens that are letters a-z alone."""
    return F.filter(words(F.lower(s)), lambda w: w.rlike("^[a-z]+$"))


def alnum_words(s: Column) -> Column:
    """Parts between characters that are neither ASCII letters nor digits."""
    return F.array_remove(F.split(s, "[^0-9A-Za-z]+"), "")


def path_parts(path: Column) -> Column:
    """table.column.index_col.row of a dumped cell's file name, whatever its folder."""
    p = F.split(F.element_at(F.split(path, "/"), -1), "\\.")
    return F.struct(p[0].alias("table_name"), p[1].alias("column_name"), p[2].alias("index_col"), p[3].alias("row_id"))


def feed_path_parts(path: Column) -> Column:
    """TABLE.row.hash.column of a feed's file name, whatever its folder."""
    p = F.split(F.element_at(F.split(path, "/"), -1), "\\.")
    return F.struct(p[0].alias("table_name"), p[1].cast("long").alias("row_id"), p[2].alias("hash"), p[3].alias("column_name"))


def version(name: Column) -> Column:
    """(base, major, minor) of base.major.minor."""
    g = lambda k: F.regexp_extract(name, "^(.*)\\.([0-9]+)\\.([0-9]+)$", k)
    return F.struct(g(1).alias("base"), g(2).cast("long").alias("major"), g(3).cast("long").alias("minor"))


def merged_name(left: Column, right: Column) -> Column:
    return F.concat(F.lit("("), left, F.lit(" "), right, F.lit(")"))


def bag_key(ws: Column) -> Column:
    """Key of a word list without regard to order."""
    return F.array_join(F.array_sort(ws), "\x00")


def word_uid(s: Column) -> Column:
    """Non-negative 64-bit identifier of a string, for parity with stored identifiers; joins use the string itself."""

    @F.pandas_udf("long")
    def uid(xs: pd.Series) -> pd.Series:
        return xs.map(string_uid).astype("Int64")

    return uid(s)


def string_uid(x: str | None) -> int | None:
    import xxhash

    if x is None:
        return None
    h = xxhash.xxh64_intdigest(x.encode(), seed=UID_SEED)
    h = h - (1 << 64) if h >> 63 else h
    return -h if h < 0 else h
