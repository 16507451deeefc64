"""Sizes of texts in tokens of a public byte-level vocabulary, whose file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("FOLIOSCOPE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# fixed value: the pattern with which this vocabulary was made
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(documents: DataFrame, keep: list[str], text: str, path: str = VOCABULARY, name: str = "tokens") -> DataFrame:
    """Columns `keep` and the number of tokens of the whole text; a null text has 0. The vocabulary must be at `path` on every machine."""

    @F.pandas_udf("int")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode_ordinary
        for batch in texts:
            yield pd.Series([len(encode(t)) if t else 0 for t in batch], dtype="int32")

    return documents.select(*keep, count(F.col(text)).alias(name))
