"""Sizes of texts in tokens of a public tokenizer.

The vocabulary is a file of ranks whose path is a parameter. The driver reads it once and sends it to the executors,
which need no file of their own; its size is checked before.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Where the ranks lie unless the caller says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Largest vocabulary file that is sent around.
MAX_BYTES = 64 * 2**20

_READY: dict[str, object] = {}


def encoding(data: bytes) -> object:
    """The encoder of a rank file's content, made once per process."""
    import tiktoken

    key = hashlib.md5(data).hexdigest()
    if key not in _READY:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        _READY[key] = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _READY[key]


def with_token_counts(df: DataFrame, text: str, into: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Add the number of tokens of column ``text``; NULL and empty text have none."""
    if os.path.getsize(vocabulary) > MAX_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MAX_BYTES} bytes")
    with open(vocabulary, "rb") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoding(sent.value)
        for batch in batches:
            yield batch.map(lambda t: len(encoder.encode_ordinary(t)) if t else 0).astype("int64")

    return df.withColumn(into, F.pandas_udf(count, LongType())(F.col(text)))
