"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.session import map_batches

#: Where the vocabulary lies; every caller can name another file of the same kind (ranks of byte pairs).
TOKENIZER = os.environ.get("BROADSHEET_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The published splitting pattern of that vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encodings: dict = {}


def encoding(path: str):
    """Encoder of the vocabulary file at ``path``; one per process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def sized(documents: DataFrame, keep: tuple[str, ...] = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, ``keep`` and n_tokens of every document with a text; an empty text has 0 tokens, null texts are left out.

    The vocabulary file is sent to the executors through Spark, so only the driver needs it.
    """
    spark = documents.sparkSession
    spark.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)
    columns = ["doc_id", *keep]
    kinds = dict(documents.dtypes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(SparkFiles.get(name)).encode_ordinary
        for pdf in batches:
            pdf["n_tokens"] = [len(encode(t)) for t in pdf["text"]]
            yield pdf[[*columns, "n_tokens"]]

    given = documents.filter(F.col("text").isNotNull()).select(*columns, "text")
    return map_batches(given, count, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", n_tokens long")
