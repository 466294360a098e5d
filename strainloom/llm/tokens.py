"""Sizes of texts in tokens of a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import base64
import functools
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Where the vocabulary files lie on every executor; a parameter of the operators.
TOKENIZER_PATH = os.environ.get("TOKENIZER_PATH", "/opt/tokenizers/byte_bpe_50k.tiktoken")


#: Fixed value: the pattern that splits text before the merges of that file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoding(path: str, pattern: str = PATTERN):
    """The byte-level BPE whose ranks are in the file, after texts are split by the pattern."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, path: str = TOKENIZER_PATH, pattern: str = PATTERN) -> Column:
    """Tokens of a text (whole, whatever its length); 0 for a null or empty one."""

    @F.pandas_udf(IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(path, pattern)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int32")

    return count(text)
