"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: rank file of a byte-level vocabulary for many languages
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: the public pattern that splits text before the merges of such rank files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(ranks: str = RANKS) -> Any:
    """The tokenizer of a rank file, loaded once per worker."""
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def n_tokens(text: str, ranks: str = RANKS) -> int:
    return len(encoder(ranks).encode_ordinary(text))


def token_count(text: Column, ranks: str = RANKS) -> Column:
    """Number of tokens of each text; null for null."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(ranks)
        for texts in batches:
            yield pd.Series([None if t is None else len(e.encode_ordinary(t)) for t in texts], dtype="Int64")

    return count(text)
