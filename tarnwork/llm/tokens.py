"""Token counts by a public byte-pair vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizers' files lie; a parameter of every operator that counts tokens.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern this vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[int, object] = {}


def encoder(data: bytes):
    """One encoder per Python worker."""
    key = hash(data)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _encoders[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def count_tokens(df: DataFrame, text: str, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of ``df`` without ``text``, with n_tokens (0 for null or empty text).

    The vocabulary file (under 1 MB) is read once and sent to the executors.
    """
    data = df.sparkSession.sparkContext.broadcast(Path(directory, vocabulary).read_bytes())
    kept = [c for c in df.columns if c != text]
    ddl = df.select(*kept).withColumn("n_tokens", F.lit(0).cast("long")).schema

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(data.value)._core_bpe.encode_ordinary
        for pdf in batches:
            out = pdf[kept].copy()
            out["n_tokens"] = [len(enc(t)) if t else 0 for t in pdf[text]]
            yield out

    return df.mapInPandas(count, ddl)
