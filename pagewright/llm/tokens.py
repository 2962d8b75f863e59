"""Counting tokens of texts with a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder with the vocabulary files of public tokenizers; a parameter of the operators, or this variable of the environment.
DEFAULT_FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
DEFAULT_FILE = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which byte-level BPE of this kind parts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, once per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str) -> int:
    """Number of tokens; 0 for null and empty texts. Strings of special tokens are ordinary text. Very long texts are counted whole."""
    return len(encoding(path).encode_ordinary(text)) if text else 0


def token_count(text: Column, folder: str = DEFAULT_FOLDER, file: str = DEFAULT_FILE) -> Column:
    path = os.path.join(folder, file)

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([count_tokens(x, path) for x in batch], dtype="int64")

    return count.asNondeterministic()(text)  # else each use of the number counts again
